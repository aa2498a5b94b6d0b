from __future__ import annotations

import pytest

from granary.llm import common


@pytest.fixture(autouse=True, scope="module")
def released(spark):
    yield
    common.release(spark)


#: Texts that every operator must take: null, empty, white space, very long, not ASCII, repeated.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "x" * 200_000), (5, "a b c " * 20_000), (6, "ñandú 😀 漢字 \u00a0 é"), (7, "same text here"),
    (8, "same text here"), (8, "same text here"), (9, "1234567890"), (10, "\x00\x01"), (None, "no id"), (11, "Same Text Here"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents, with columns whose names operators also use for their own."""
    rows = [(i, t, None if (i or 0) % 2 else "en", None, 1, "mine", "mine", "mine") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score string, label string").cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
