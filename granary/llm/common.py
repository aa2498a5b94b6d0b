"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``; a local session without that setting gets a
    folder of its own, and a cluster without it is an error, as a local folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


#: The folders that this process has written.
_WRITTEN: list[str] = []


def written() -> int:
    """How many tables ``materialise`` has written in this process and not removed."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Remove the tables that ``materialise`` has written in this process, from one number of ``written`` on,
    all or all but the last. Only for when no DataFrame that reads them will run again."""
    to = len(_WRITTEN) - bool(but_last)
    gone = _WRITTEN[since:to]
    del _WRITTEN[since:to]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A driver whose heap has grown over this share of the most that it may take collects its garbage.
HEAP_SHARE = 0.4


def collect_garbage(spark: SparkSession) -> bool:
    """Let the driver collect its garbage, if its heap has grown over HEAP_SHARE; whether it had.
    What many small jobs leave (plans, broadcasts, accounts of tasks) is little, but a heap that is only
    collected as it fills grows to its most, and broadcasts and shuffle files stay until it is collected."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() < HEAP_SHARE * runtime.maxMemory():
        return False
    gc.collect()  # frames that Python holds in circles hold plans and broadcasts
    spark.sparkContext._jvm.System.gc()
    return True


def materialise(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: it cuts the lineage, is
    computed once, and outlives any executor. The files stay until ``release``. narrow: for tables of
    few bytes a document; they are computed at full width, and their rows then dealt to as many files
    as the cluster has cores, or a sixteenth of the shuffle's partitions if that is more, as many small
    files are slow to write and to read. The driver may collect its garbage then."""
    spark = df.sparkSession
    if narrow:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(max(1, spark.sparkContext.defaultParallelism, partitions // 16))
    top = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    _WRITTEN.append(top)
    path = f"{top}/{name}"
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda, a column expression is computed anew for
    each element, but a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(sizes: Column, run: int = 64) -> Column:
    """For an array of sizes, where each begins: the sums of all before it. Sums of whole runs come first,
    so that the work stays near linear."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    runs = lambda xs: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / run).cast("int") - 1, F.lit(0))), lambda r: total(F.slice(xs, r * run + 1, F.lit(run)))
    )

    def below(xs: Column, bases: Column) -> Column:
        def at(i: Column) -> Column:
            r = F.floor(i / run).cast("int")
            return F.get(bases, r) + total(F.slice(xs, r * run + 1, i - r * run))

        return F.transform(xs, lambda _, i: at(i))

    def of_runs(sums: Column) -> Column:
        return F.transform(sums, lambda _, r: total(F.slice(sums, F.lit(1), r)))

    return let(sizes, lambda xs: let(runs(xs), lambda sums: let(of_runs(sums), lambda bases: below(xs, bases))))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Arrow batches have at most so many rows, and about so many bytes: whole texts may be long,
    and a batch is held in memory on both sides. It lowers the session's settings and never raises
    them. Python workers also get this package's folder on their path, for sessions that were started
    elsewhere."""
    at = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if at not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), at) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < as_bytes(spark.conf.get(key)) <= size:
        spark.conf.set(key, str(size))


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about max_bytes (at least one row each), so that
    memory is bounded by bytes, not by rows."""
    try:
        yield from _regrouped(batches, max_bytes)
    finally:
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks


def _regrouped(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(batch.num_rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            part_bytes = batch.nbytes * part.num_rows // batch.num_rows
            if held and size + part_bytes > max_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part_bytes
    if held:
        yield pa.Table.from_batches(held)
