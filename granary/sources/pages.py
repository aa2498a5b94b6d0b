"""Page files: fixed-width records in pages, for exchange with programs that keep their rows so.

The layout of a file is fixed: pages of ``PAGE`` bytes; as many whole records in each as fit, then zeros; a
record is its fields one after the other in network byte order, INTEGER in 4 bytes, BIGINT in 8, FLOAT in 4
(IEEE 754), STRING(n) in n bytes of UTF-8 filled up with zeros. All pages but the last are full.

Reading is distributed by pages. Writing streams the rows of one partition after the other through the
driver, as Spark has no sink for raw bytes; it is an export, and tables of the engine itself are Parquet.

Nulls have no form in such a record and become 0 or empty. Without the number of rows, slots that hold
nothing but zeros count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError
from granary.functions.types import DEFAULT_SIZE, Field, cut_bytes, schema_of
from granary.sources.files import Files

#: Fixed value: the bytes of a page.
PAGE = 4096


def record_type(fields: list[Field]) -> np.dtype:
    """A record's fields as they lie in a page."""
    kinds = {"INTEGER": ">i4", "BIGINT": ">i8", "FLOAT": ">f4"}
    found = np.dtype([(f.name, kinds.get(f.type) or f"S{f.size or DEFAULT_SIZE}") for f in fields])
    if found.itemsize > PAGE:
        raise AnalysisError(f"a record of {found.itemsize} bytes does not fit into a page of {PAGE}")
    return found


def byte_map(spark: SparkSession, fields: list[Field]) -> DataFrame:
    """(field, type, first, last): the bytes of a record that each field takes."""
    kind = record_type(fields)
    rows = [(f.name, f.type, kind.fields[f.name][1], kind.fields[f.name][1] + kind.fields[f.name][0].itemsize - 1) for f in fields]
    return spark.createDataFrame(rows, "field string, type string, first int, last int")


def write_pages(df: DataFrame, fields: list[Field], path: str) -> int:
    """Write df's columns of these names, in its order, to one file. Returns the number of rows."""
    kind = record_type(fields)
    per_page = PAGE // kind.itemsize
    columns = [
        cut_bytes(F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")), f.size or DEFAULT_SIZE).alias(f.name)
        if f.type == "STRING"
        else F.coalesce(F.col(f"`{f.name}`").cast(f.struct_field().dataType), F.lit(0).cast(f.struct_field().dataType)).alias(f.name)
        for f in fields
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = np.zeros(batch.num_rows, kind)
            for f in fields:
                values = batch[f.name].to_pylist()
                records[f.name] = [v.encode() for v in values] if f.type == "STRING" else values
            yield pa.RecordBatch.from_arrays([pa.array([records.tobytes()], pa.binary())], ["records"])

    files = Files(df.sparkSession)
    n, waiting = 0, b""
    with files.writing(path) as write:
        for row in df.select(*columns).mapInArrow(run, "records binary").toLocalIterator():
            waiting += bytes(row.records)
            n += len(row.records) // kind.itemsize
            whole = len(waiting) // kind.itemsize // per_page
            for i in range(whole):
                write(waiting[i * per_page * kind.itemsize : (i + 1) * per_page * kind.itemsize].ljust(PAGE, b"\0"))
            waiting = waiting[whole * per_page * kind.itemsize :]
        if waiting:
            write(waiting.ljust(PAGE, b"\0"))
    return n


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, bytes) of a file."""
    try:
        found = spark.sparkContext.binaryRecords(path, PAGE).zipWithIndex()
    except Py4JJavaError as e:
        raise AnalysisError(f"{path!r} cannot be read: {e.java_exception.getMessage()}") from e
    return found.map(lambda x: (x[1], bytearray(x[0]))).toDF("page bigint, bytes binary")


def read_pages(spark: SparkSession, path: str, fields: list[Field], rows: int | None = None) -> DataFrame:
    """The records of a file, in its order. rows: how many it holds."""
    kind = record_type(fields)
    per_page = PAGE // kind.itemsize
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema_of(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, raw in zip(batch["page"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                records = np.frombuffer(raw, kind, per_page)
                if rows is not None:
                    records = records[: max(0, rows - page * per_page)]
                else:
                    taken = np.frombuffer(raw, np.uint8, per_page * kind.itemsize).reshape(per_page, kind.itemsize).any(1)
                    records = records[taken]
                made = [
                    pa.array([v.decode(errors="replace") for v in records[f.name].tolist()], pa.string())
                    if f.type == "STRING"
                    else pa.array(records[f.name].astype(records[f.name].dtype.newbyteorder("=")))
                    for f in fields
                ]
                yield pa.RecordBatch.from_arrays(made, [f.name for f in fields])

    return _pages(spark, path).mapInArrow(run, schema)


def hex_view(spark: SparkSession, path: str, page: int) -> DataFrame:
    """(offset, hex, ascii) of one page, 16 bytes a line; what is no printable ASCII is a dot."""
    line = F.explode(F.sequence(F.lit(0), F.lit(PAGE - 16), F.lit(16))).alias("offset")
    rows = _pages(spark, path).where(F.col("page") == page).select(line, "bytes")
    part = F.substring("bytes", F.col("offset") + 1, F.lit(16))
    text = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    return rows.select("offset", F.regexp_replace(F.hex(part), "(..)(?=.)", "$1 ").alias("hex"), text.alias("ascii"))
