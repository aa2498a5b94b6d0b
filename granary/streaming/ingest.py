"""CSV files that arrive in a folder are loaded into a table as they come.

Each micro-batch is coerced and appended as a one-off load is. A batch that runs again after a failure
is recognised by its number, which becomes visible in the manifest together with its rows, and does
not load twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from granary.functions.types import coerced
from granary.sources.catalog import Catalog


def watch(catalog: Catalog, folder: str, table: str, checkpoint: str, header: list[str] | None = None) -> StreamingQuery:
    """Load what is in folder now and end; call it again for what comes later. The table must exist.
    header: the columns of the files, by default the table's."""
    fields = catalog.table(table).fields
    names = header or [f.name for f in fields]
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names])

    def load(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.select(*[coerced(F.col(f"`{f.name}`") if f.name in names else F.lit(""), f).alias(f.name) for f in fields])
        catalog.append(table, rows, (checkpoint, number))

    stream = catalog.spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(folder)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
