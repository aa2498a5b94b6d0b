r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; each is compared with its neighbours, so
that adjacent turns of one role make a block, and all are written as one string::

    <turn user
    text of a turn<next/>text of a second turn in a row</turn>
    <turn assistant
    ...</turn>

Control strings inside roles and texts are escaped reversibly: a backslash followed by one digit
stands for the backslash itself or for one control string, so an escaped text holds no control
string and every backslash in it begins exactly one escape.

Defined results: null roles and texts count as empty; turns sort by turn (null first), then role,
then text, so ties have one order; repeated rows are turns of their own; rows with a null conv_id
form one conversation; extra columns are ignored; no rows give no conversations. One conversation is
one output string, so its turns meet in one task; nothing else is gathered, and the work is in
proportion to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import let, starts

OPEN, CLOSE, NEXT = "<turn ", "</turn>\n", "<next/>"
#: Each control string and the escape that stands for it in a text; the backslash comes first.
ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("<turn ", "\\2"), ("<next/>", "\\3"))
#: A role stands on the line of its turn's mark, so it has no line feed either.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\4"))


def escape(c: Column, escapes=ESCAPES) -> Column:
    for plain, coded in escapes:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column, escapes=ESCAPES) -> Column:
    for plain, coded in reversed(escapes):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length, in code points,
    of each loss_role text inside formatted, without marks)."""
    blank = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
    )
    rows = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    # Adjacent turns of one role share a block: a turn opens one if its role differs from that of the turn
    # before, and closes it if it differs from that of the turn after. Every turn is a piece: the mark
    # before its text, the text, and the mark after it.
    def piece(turns_: Column, t: Column, i: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"))
        before = F.when(F.get(turns_, i - 1)["role"].eqNullSafe(t["role"]), blank).otherwise(head)
        after = F.when(F.get(turns_, i + 1)["role"].eqNullSafe(t["role"]), F.lit(NEXT)).otherwise(F.lit(CLOSE))
        return F.struct(before.alias("before"), escape(t["text"]).alias("text"), after.alias("after"), (t["role"] == loss_role).alias("loss"))

    pieces = let(F.col("turns"), lambda ts: F.transform(ts, lambda t, i: piece(ts, t, i)))
    rows = rows.select(conv_col, pieces.alias("pieces"))
    length = lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("bigint")
    rows = rows.select(conv_col, "pieces", starts(F.transform("pieces", length)).alias("starts"))

    def span(p: Column, at: Column) -> Column:
        start = at + F.length(p["before"])
        return F.when(p["loss"], F.struct(start.alias("start"), F.length(p["text"]).cast("bigint").alias("length")))

    spans = F.filter(F.zip_with("pieces", "starts", span), lambda s: s.isNotNull())
    return rows.select(
        conv_col,
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Read a formatted string back: array of (role, text), one per turn."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(len(OPEN) + 1), F.length(b))
        at = F.instr(body, "\n")
        role = unescape(F.substring(body, F.lit(1), at - 1), ROLE_ESCAPES)
        texts = F.split(F.substring(body, at + 1, F.length(body)), NEXT)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order. Code points of one width are cut at once, where
    those of UTF-8 would be counted from the string's start for each span."""

    def cut(wide: Column) -> Column:
        one = lambda s: F.decode(F.substring(wide, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")), "UTF-32")
        return F.array_join(F.transform(spans, lambda s: unescape(one(s))), "")

    return let(F.encode(formatted, "UTF-32"), cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    done = format_conversations(turns.unionByName(more))
    read = F.col("read")
    done = done.withColumn("read", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        "conv_id",
        F.size(read).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *,
    length(replace(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '<turn ', '\2'), '<next/>', '\3')) AS text_chars,
    length(replace(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '<turn ', '\2'), '<next/>', '\3'), chr(10), '\4')) AS role_chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN opens = 1 THEN 6 + role_chars + 1 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
