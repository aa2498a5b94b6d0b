from __future__ import annotations

import random
import re

import pytest
from tokenizers import Tokenizer

from granary.llm import bpe

PIECES = [
    " ", "  ", "\n", "\t", "a", "B", "é", "1", "２", "'", "'s", "'ll", "!", "?!", "<|endoftext|>", "<|", "日本", "か", "\u00a0", "\u2003", "\u3000",
    "😀", "\x1c", "\x85", "ß", "_", "\u0300", "\u200b", "²", "Ⅷ", "\u1c89",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def both(df):
    rows = bpe.decode(bpe.encode(df), text_col="back").select("doc_id", "text", "ids", "back").collect()
    return [(r.text or "", r.ids, r.back) for r in rows]


def held(rows, tokenizer):
    for text, ids, back in rows:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == expected, repr(text[:80])
        assert back == tokenizer.decode(expected, skip_special_tokens=False), repr(text[:80])


def test_random_texts(spark, tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    held(both(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), tokenizer)


def test_documents(spark, sf_dir, tokenizer):
    held(both(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), tokenizer)


def test_every_stable_character(spark, tokenizer):
    """Java's classes and the library's agree on the characters that are split in Spark."""
    own = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", bpe.STABLE)
    stable = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and re.match(f"[{own}]", c)]
    texts = ["".join(f"a{c} 1{c}!{c} {c}a" for c in stable[i : i + 300]) for i in range(0, len(stable), 300)]
    held(both(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), tokenizer)


def test_odd(odd, none, tokenizer):
    rows = bpe.decode(bpe.encode(odd), text_col="back").collect()
    assert len(rows) == odd.count() and {r.id for r in rows} == {"mine"}
    held(both(odd), tokenizer)
    assert bpe.encode(none).count() == 0


def test_decode_bad_ids(spark):
    df = spark.createDataFrame([(1, [64, None, -1, 10**6, 65]), (2, None), (3, []), (4, [126, 64])], "k int, ids array<int>")
    got = {r.k: r.text for r in bpe.decode(df).collect()}
    assert got == {1: "ab", 2: "", 3: "", 4: got[4]} and got[4].endswith("a")


def test_cache_starts_anew(spark, tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "CALL_WORDS", 2)
    for words in (["one", " two", " three", " four", "one"], [" five", "one", " six"]):
        got = bpe._encode(pa.array([words, []], pa.list_(pa.string())), bpe.default_path()).to_pylist()
        assert got == [tokenizer.encode("".join(words), add_special_tokens=False).ids, []]
