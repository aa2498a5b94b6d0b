r"""Byte-level BPE encoding and decoding by tables of distinct words.

Encoding splits each text into words in Spark (``regexp_extract_all``), then works on bounded
chunks of documents: the chunk's words become a table of distinct words with, for each position,
an index into it; every distinct word is encoded once with the tokenizers library; the ids are
joined back by position. Decoding joins ids to the vocabulary's byte pieces and concatenates them.
Both joins are Arrow ``take`` calls on tables of bounded size, so no word or token is ever a row of
a shuffle: nothing is shuffled at all, a lost executor repeats only its own tasks, and memory does
not depend on the number of distinct words in the corpus, which grows with it.

A text that holds a special token, or a character whose class may differ between Unicode versions
(anything outside ``STABLE``), is one "word" by itself: the library then splits it.

Defined results: a null text is an empty one and has no ids; unknown or null ids decode to nothing;
null ids arrays decode to an empty text; repeated rows are encoded alike; an empty table gives an
empty one; a column that has the output's name already is replaced, all others pass through.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import chunks, small_batches, text_or_empty

#: Bytes of Arrow data that are worked on at once.
CHUNK_BYTES = 4 << 20
#: A worker keeps the ids of so many words at most from one chunk to the next; then it starts anew.
KEPT_WORDS = 250_000
#: So many words are encoded in one call, as the library's results are large.
CALL_WORDS = 20_000
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The words of byte-level BPE, the commonest kind first; only the kinds after the third overlap with
#: others. Java's \s is ASCII only, so white space is spelt out.
WORDS = (
    r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The first of the stable ranges, which holds most texts and is quick to test for.
LATIN = r"\x{0}-\x{220}"
#: Ranges whose letters, numbers and white space every Unicode version since 4 agrees on.
STABLE = (
    LATIN + r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{410}-\x{44F}\x{2000}-\x{200A}\x{2010}-\x{2027}"
    r"\x{2030}-\x{2052}\x{20AC}\x{3000}-\x{3003}\x{3041}-\x{3094}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _pieces(path: str) -> pa.Array:
    """The bytes of each id; one more entry, empty, is for ids that do not exist."""
    tokens = {i: t for t, i in _tokenizer(path).get_vocab(with_added_tokens=True).items()}
    table, out = _byte_of_char(), []
    for i in range(max(tokens, default=-1) + 1):
        token = tokens.get(i, "")
        own = [table.get(c) for c in token]
        out.append(token.encode() if None in own else bytes(own))
    return pa.array([*out, b""], pa.binary())


def _list_offsets(column: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


@lru_cache(maxsize=2)
def _kept(path: str) -> dict[str, bytes]:
    return {}


def _encode_distinct(words: list[str], path: str) -> list[bytes]:
    """The ids of each word, as the bytes of int32 numbers."""
    kept = _kept(path)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    new = [w for w in words if w not in kept]
    found: dict[str, bytes] = {}
    for i in range(0, len(new), CALL_WORDS):
        part = new[i : i + CALL_WORDS]
        for w, e in zip(part, _tokenizer(path).encode_batch_fast(part, add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, np.int32).tobytes()
    out = [found.get(w) or kept.get(w, b"") for w in words]
    kept.update((w, b) for w, b in found.items() if len(w) < 64)
    return out


def _encode(words: pa.Array, path: str) -> pa.Array:
    """A list of words per document becomes a list of ids per document."""
    coded = pc.list_flatten(words).dictionary_encode()
    encoded = _encode_distinct(coded.dictionary.to_pylist(), path)
    lengths = np.fromiter(map(len, encoded), np.int32, len(encoded)) // 4
    flat = np.frombuffer(b"".join(encoded), np.int32)
    table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
    at = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths[at])])
    ids = pc.list_flatten(table.take(coded.indices)) if len(at) else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends[_list_offsets(words)], pa.int32()), ids)


def _decode(ids: pa.Array, path: str) -> pa.Array:
    """A list of ids per document becomes a text per document; broken UTF-8 becomes U+FFFD."""
    pieces = _pieces(path)
    flat = pc.fill_null(pc.list_flatten(ids), -1).to_numpy(zero_copy_only=False)
    none = len(pieces) - 1
    taken = pieces.take(pa.array(np.where((flat < 0) | (flat > none), none, flat)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(_list_offsets(ids), pa.int32()), taken), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


def _mapped(df: DataFrame, read: str, write: str, kind: T.DataType, f: Callable[[pa.Array, str], pa.Array], path: str) -> DataFrame:
    """df with column ``read`` replaced by column ``write``, chunk by chunk."""
    fields = [x for x in df.schema.fields if x.name not in (read, write)]
    names = [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK_BYTES):
            made = f(table[read].combine_chunks(), path)
            yield from table.select(names).append_column(write, made).combine_chunks().to_batches()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(write, kind)]))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column of ids (array<int>)."""
    path = path or default_path()
    text = text_or_empty(text_col)
    whole = text.rlike(f"[^{LATIN}]") & text.rlike(f"[^{STABLE}]")
    for special in _specials(path):
        whole = whole | text.contains(special)
    words = F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))
    return _mapped(docs.withColumn("__words", words), "__words", ids_col, T.ArrayType(T.IntegerType()), _encode, path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The same vocabulary for the library that reads it from a file of ranks, which is faster at whole texts."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(docs: DataFrame, text_col: str = "text", out_col: str = "n_ids", path: str | None = None, ranks: str | None = None) -> DataFrame:
    """docs with the number of ids of each text, but without the text itself. path, ranks: the vocabulary in
    both forms. Texts with a special token are counted by the first, as ``encode`` does."""
    path = path or default_path()
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def counted(texts: pa.Array, path: str) -> pa.Array:
        fast, specials = _ranked(ranks), _specials(path)

        def one(text: str) -> int:
            if any(s in text for s in specials):
                return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)
            return len(fast.encode_ordinary(text))

        return pa.array([one(t) for t in texts.to_pylist()], pa.int64())

    return _mapped(docs.withColumn("__text", text_or_empty(text_col)).drop(text_col), "__text", out_col, T.LongType(), counted, path)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """rows with a column of texts, special tokens included, beside their ids."""
    return _mapped(rows.withColumn("__ids", F.col(ids_col)), "__ids", text_col, T.StringType(), _decode, path or default_path())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs).select("doc_id", "ids"), text_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
