from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import near_dedup as nd
from granary.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def top(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    u, index = Union(sets), defaultdict(list)
    for i, s in sets.items():
        for h in s:
            index[h].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for h in s for j in index[h] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
    return {i: (len(sets[i]), u.top(i)) for i in sets}


def found(df, config, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nd.find(df, config, **more).collect()}


@pytest.mark.parametrize(("words", "percent", "bands"), [(3, 85, 20), (5, 80, 28)])
def test_documents(spark, sf_dir, words, percent, bands):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    expected = brute([tuple(r) for r in docs.collect()], words, percent)
    assert found(docs, nd.Config(words, percent, bands)) == expected
    kept = sorted(r.doc_id for r in nd.deduplicate(docs, nd.Config(words, percent, bands)).collect())
    assert kept == sorted(i for i, (_, c) in expected.items() if i == c)


def near_copies(n, size, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_large_groups_in_small_blocks(spark):
    """One large group around the threshold, dealt to many blocks: no link is lost."""
    texts = near_copies(150, 120, 5, 1) + near_copies(40, 60, 3, 2) + [f"other {i} text here" for i in range(30)]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    config = nd.Config(3, 85, 20)
    expected = brute(rows, 3, 85)
    assert len({c for _, c in expected.values()}) < 150
    assert found(df, config, most_rows=16) == expected
    assert found(df, config, most_rows=16, bucket_rows=3) == expected
    assert found(df, config) == expected


def test_odd(odd, none):
    rows = {r.doc_id: r for r in nd.find(odd, nd.Config(3, 85, 20)).collect()}
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0
    assert [rows[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert rows[8].component_id == rows[11].component_id == 7 and rows[5].n_shingles == 3
    assert rows[None].component_id is None and rows[None].kept
    kept = nd.deduplicate(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - {8, 11}
    assert nd.find(none).count() == 0 and nd.deduplicate(none).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85):
        same = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = int(600 * share)
            half = (600 - n) // 2
            a, b = x[: n + half], np.concatenate([x[:n], x[n + half :]])
            one, two = nd.sketch(a, 128), nd.sketch(b, 128)
            same.append((one == two).mean())
            assert np.array_equal(nd.sketch(x, 128), np.maximum(one, two))
        assert abs(np.mean(same) - share) < 0.03


def test_likelihood_keeps_what_may_link():
    rng = np.random.default_rng(1)
    for share, expected in ((0.85, True), (0.3, False)):
        kept = []
        for _ in range(50):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * share)
            a, b = x[: n + (400 - n) // 2], np.concatenate([x[:n], x[n + (400 - n) // 2 :]])
            kept.append(bool(nd.may_reach(85, nd.sketch(a, 80), nd.sketch(b, 80)[None], len(a), np.array([len(b)]))[0]))
        assert all(kept) if expected else not any(kept)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (None, 7), (20, 19)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 5: 5, 19: 19, 20: 19} | dict.fromkeys(range(100, 161), 100)
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("percent", "m"), [(85, 80), (80, 112)])
def test_pruning_rarely_loses_a_pair_at_the_threshold(percent, m):
    """By the multinomial of registers that are greater, less and equal, of two sets of one size."""
    c, base = (nd.BASE - 1) / nd.BASE, math.log(nd.BASE)
    differ = -math.log(1 - c * (0.5 - percent / 200)) / base  # of a register, each way
    ways = np.array([(a, b) for a in range(m + 1) for b in range(m + 1 - a)])
    log = np.cumsum(np.log(np.maximum(np.arange(m + 1), 1)))
    above, below = ways.T
    same = m - above - below
    likely = np.exp(log[m] - log[above] - log[below] - log[same] + (above + below) * math.log(differ) + same * math.log(1 - 2 * differ))
    at = np.arange(m)
    others = np.where(at < above[:, None], 0, np.where(at < (above + below)[:, None], 2, 1)).astype(np.uint16)
    size = np.full(len(ways), 1000)
    kept = nd.may_reach(percent, np.ones_like(others), others, size, size)
    assert abs(likely.sum() - 1) < 1e-9 and likely[~kept].sum() < 1e-7


def test_prefixes_meet_wherever_sets_reach_the_threshold():
    """Two sets in one order: the first common element lies in both prefixes."""
    rng = random.Random(4)
    for percent in (80, 85):
        met = 0
        for _ in range(4000):
            universe = list(range(rng.randint(1, 60)))
            x = sorted(rng.sample(universe, rng.randint(1, len(universe))))
            y = sorted((set(x) - set(rng.sample(x, rng.randint(0, len(x) // 6)))) | set(rng.sample(universe, rng.randint(0, len(universe) // 12))))
            if y and 100 * len(set(x) & set(y)) >= percent * len(set(x) | set(y)):
                x, y = sorted((x, y), key=len)
                assert set(x[: nd.prefix_sizes(percent, len(x))[0]]) & set(y[: nd.prefix_sizes(percent, len(y))[1]])
                met += 1
        assert met > 500


def template(n, size, own, seed, kinds=1):
    """Pages of one template, each with a run of words of its own."""
    rng = random.Random(seed)
    bases = [[f"t{k}w{i}" for i in range(size)] for k in range(kinds)]
    return [" ".join(bases[i % kinds] + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for i in range(n)]


def test_work_on_templates_grows_with_their_number(spark, monkeypatch):
    """Pages of one template at a similarity of 0.71 to 0.74, under the threshold: all are candidates of one
    another, yet the rows that tasks compare grow in proportion."""
    seen = []
    plain = nd._linked
    monkeypatch.setattr(nd, "_linked", lambda rows, *more: seen.append(rows.count()) or plain(rows, *more))
    work = []
    for n in (500, 1000, 2000):
        seen.clear()
        rows = [(i, t) for i, t in enumerate(template(n, 100, 18, n))]
        got = found(spark.createDataFrame(rows, "doc_id long, text string"), nd.Config(3, 85, 20))
        assert got == {i: (116, i) for i in range(n)}
        work.append(sum(seen))
    assert all(b <= 2.3 * a for a, b in zip(work, work[1:])), work


def test_links_in_large_groups_of_templates(spark):
    """Of many pages of two templates some are near copies of others, in other blocks, and are found."""
    rng = random.Random(9)
    texts = template(300, 100, 14, 1, kinds=2) + template(200, 60, 4, 2)
    for _ in range(120):
        words = rng.choice(texts).split()
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 3, 85)
    for blocks in (16, 64):
        assert found(df, nd.Config(3, 85, 20), most_rows=blocks) == expected
    expected = brute(rows, 5, 80)
    assert found(df, nd.Config(), most_rows=16, bucket_rows=8) == expected


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = near_copies(2, 60, 60, 1), near_copies(2, 60, 60, 2)
    rows = [(1, a[0]), (1, b[0]), (2, a[0] + " more"), (3, b[0] + " more"), (4, "something else"), (4, a[0])]
    got = nd.find(spark.createDataFrame(rows, "doc_id long, text string"), nd.Config(3, 85, 20)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Nodes in a row, with ids in any order: rounds grow with the logarithm of their number."""
    from granary.llm import components as module

    written = []
    plain = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name, narrow=False: written.append(name) or plain(df, name, narrow))
    for n in (300, 3_000):
        ids = list(range(n))
        random.Random(n).shuffle(ids)
        written.clear()
        got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
        assert {r.node for r in got} == set(ids) and {r.label for r in got} == {0}
        assert written.count("labels") - 1 <= 2 + math.log2(n), written
