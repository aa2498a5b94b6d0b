from __future__ import annotations

import random
import time
from collections import defaultdict

from granary.llm import bpe
from granary.llm.packing import by_tokens, pack, place


def naive(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [i for i, b in enumerate(bins) if b[0] >= size and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fits:
            k = min(fits, key=lambda i: (bins[i][0], i))
        else:
            k = len(bins)
            bins.append([capacity, set(), set(), 0])
        b = bins[k]
        out.append((k, b[3], capacity - b[0]))
        b[0] -= size
        b[1].add(source)
        b[2].add(cluster)
        b[3] += 1
    return out


def test_pack_is_best_fit():
    rng = random.Random(0)
    for _ in range(20):
        items = [(rng.randint(1, 50), rng.choice(["hot", "hot", None, "a", "b", "c"]), rng.choice([None, *range(30)])) for _ in range(300)]
        items.sort(key=lambda x: -x[0])
        assert pack(items, 60) == naive(items, 60)
    assert pack([], 5) == []


def held(rows, docs, capacity):
    """Every token of every document is placed once; no bin overflows or holds a conflict."""
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        assert sum(r.n_tokens for r in members) <= capacity
        assert [r.place for r in members] == list(range(len(members)))
        assert all(a.offset + a.n_tokens == b.offset for a, b in zip(members, members[1:]))
        sources = [docs[r.doc_id][1] for r in members if docs[r.doc_id][1] is not None]
        texts = [docs[r.doc_id][0] for r in members]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    for key, (text, _) in docs.items():
        mine = sorted(pieces[key], key=lambda r: r.start)
        assert mine and mine[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(mine, mine[1:]))
        assert mine[-1].start + mine[-1].n_tokens == -(-len((text or "").encode()) // 4) + 1


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by_id = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    held(place(docs, 500, shard_rows=40).collect(), by_id, 500)
    held(place(docs).collect(), by_id, 2048)


def test_odd(odd, none):
    rows = place(odd, 100).collect()
    by_id = {r.doc_id: (r.text, None) for r in odd.collect() if r.doc_id not in (None, 8)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    assert sum(r.doc_id == 8 for r in rows) == 2  # both rows of one id
    for key in by_id:
        mine = [r for r in rows if r.doc_id == key]
        assert sum(r.n_tokens for r in mine) == -(-len((by_id[key][0] or "").encode()) // 4) + 1
    same = [r.bin_id for r in rows if r.doc_id in (7, 8)]
    assert len(set(same)) == 3  # copies never share a bin
    assert place(none).count() == 0


def test_sizes_are_tokens(spark, sf_dir, odd):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        ids = {}
        for r in bpe.encode(docs.select("doc_id", "text")).collect():
            ids[r.doc_id] = ids.get(r.doc_id, 0) + len(r.ids) + 1
        placed = {}
        rows = by_tokens(docs, 300).collect()
        for r in rows:
            placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
        assert placed == ids
        per_bin = {}
        for r in rows:
            per_bin.setdefault(r.bin_id, []).append((r.offset, r.n_tokens))
        assert all(sum(n for _, n in sorted(b)) <= 300 for b in per_bin.values())
    assert by_tokens(odd.limit(0)).count() == 0
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, " " * 300_000 + "x", "1" * 300_000, "é" * 100_000, "ab " * 100_000, "\n" * 100_000, "\u200b\u0300Ⅷ²"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_ids for r in bpe.count(df).collect()} == {r.doc_id: len(r.ids) for r in bpe.encode(df).collect()}


def test_repeated_rows_take_linear_time(spark):
    """Rows that agree in all that deals them fall to one shard, which is packed piece by piece."""
    n = 30_000
    df = spark.createDataFrame([(None, "the same text", "s")], "doc_id long, text string, source string").crossJoin(spark.range(n)).drop("id")
    began = time.time()
    rows = place(df).collect()
    assert time.time() - began < 40
    assert len(rows) == n and len({r.bin_id for r in rows}) == n  # copies never share a bin
