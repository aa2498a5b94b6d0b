"""CSV files: loading into tables, with inferred or declared columns, and points for benchmarks.

Quoted fields may hold line breaks, so a file is one task, and many files load in parallel; of files
that are known to have none (multi_line=False), one file is many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.errors import AnalysisError
from granary.functions.types import Field, coerced, field_of_samples
from granary.sources.catalog import Catalog, Table
from granary.sources.files import shared_root

#: The rows whose lengths count, the rows that decide the types, and the characters of a name.
SAMPLE_ROWS, TYPED_ROWS, NAME_CHARS = 100, 20, 30


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """All columns as strings."""
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "sep": sep, "encoding": encoding, "inferSchema": False}
    return spark.read.options(**options).csv(path)


def infer_fields(raw: DataFrame) -> list[tuple[str, Field]]:
    """(column of the file, field) from the first rows; columns without a name are left out. One small
    aggregate over the sample decides for all columns at once."""
    named = [(header, name) for header in raw.columns if (name := header[:NAME_CHARS].strip()) and not (name.startswith("_c") and name[2:].isdigit())]
    if not named:
        return []
    rows = raw.select(*[F.coalesce(_column(h), F.lit("")).alias(f"v{i}") for i, (h, _) in enumerate(named)]).limit(SAMPLE_ROWS)
    rows = rows.withColumn("__at", F.monotonically_increasing_id())  # what a limit leaves is one partition
    found = rows.agg(*[field_of_samples(F.col(f"v{i}"), F.col("__at") < TYPED_ROWS).alias(f"f{i}") for i in range(len(named))]).first()
    return [(header, Field(name, found[i]["type"], found[i]["size"])) for i, (header, name) in enumerate(named)]


def _column(header: str):
    return F.col("`" + header.replace("`", "``") + "`")


def ingest(
    catalog: Catalog,
    path: str,
    table: str,
    progress: Callable[[int, int], None] | None = None,
    spatial: tuple[str, str] | None = None,
    multi_line: bool = True,
) -> int:
    """Load a CSV file with a header. A table that does not exist is created from its first rows; one
    that does takes the columns it has, by name, and zeros or empty strings for those it lacks. progress is
    called with the rows loaded so far and all rows, several times while a long load runs, and at its end.
    Returns the number of rows; a file without rows creates nothing."""
    raw = read_csv(catalog.spark, path, multi_line=multi_line)
    if not raw.columns or raw.isEmpty():
        if progress:
            progress(0, 0)
        return 0
    if table not in catalog.tables:
        found = infer_fields(raw)
        if not found:
            raise AnalysisError(f"{path!r} has no named columns")
        fields = [f for _, f in found]
        names = {f.name for f in fields}
        pair = spatial if spatial and set(spatial) <= names else None
        catalog.create(Table(table, fields, key=fields[0].name, spatial=pair))
        by_field = {f.name: header for header, f in found}
    else:
        if spatial:
            catalog.set_spatial(table, spatial)
        fields = catalog.table(table).fields
        headers = {h[:NAME_CHARS].strip(): h for h in reversed(raw.columns)} | {h: h for h in raw.columns}
        by_field = {f.name: headers[f.name] for f in fields if f.name in headers}
    rows = raw.select(*[coerced(_column(by_field[f.name]) if f.name in by_field else F.lit(""), f).alias(f.name) for f in fields])
    return catalog.append(table, rows, progress=progress)


def with_row_numbers(df: DataFrame, name: str = "ID") -> DataFrame:
    """df with dense numbers from 1 in its present order, in place of a column of that name: each partition
    counts its own rows, and only the counts of the partitions meet on the driver. The rows are computed once
    and written to the shared folder with their partition and place in it: if they ran again for the result,
    a sort would draw its ranges from another sample, and the counts would be those of other partitions."""
    spark, at, start = df.sparkSession, F.col("at"), F.col("start")
    path = f"{shared_root(spark)}/granary-numbered/{uuid.uuid4().hex}"
    held = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("at", F.monotonically_increasing_id())
    held.write.parquet(path)
    # The id's upper bits are the partition, its lower 33 the place.
    rows = spark.read.schema(held.schema).parquet(path).withColumn("part", F.shiftright(at, 33))
    counts = sorted(map(tuple, rows.groupBy("part").agg(F.count(F.lit(1))).collect()))
    before = accumulate((n for _, n in counts), initial=0)
    starts = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, before)], "part bigint, start bigint")
    number = start + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    same = str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    others = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if same(c) != same(name)]
    return rows.join(F.broadcast(starts), "part").select(number.alias(name), *others)


def load_points(
    spark: SparkSession, path: str, name: str, lat: str, lon: str, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """(ID, Name, Lat, Lon) of the rows whose coordinates can be read; Name is cut to 20 characters."""
    raw = read_csv(spark, path, sep, encoding)
    number = lambda c: F.trim(_column(c)).try_cast("double")
    rows = raw.select(
        F.substring(F.trim(F.coalesce(_column(name), F.lit(""))), 1, 20).alias("Name"), number(lat).alias("Lat"), number(lon).alias("Lon")
    )
    rows = rows.where(F.col("Lat").isNotNull() & F.col("Lon").isNotNull())
    return with_row_numbers(rows).select(F.col("ID").cast("int"), "Name", F.col("Lat").cast("float"), F.col("Lon").cast("float"))


#: The demonstration tables, each with its columns, the column of its CSV file that each
#: comes from ("#" is the row number), and its spatial pair.
DEMO = {
    "Canciones": ([
        ("ID", "INTEGER", None, "#"), ("Year", "INTEGER", None, "year"), ("Country", "STRING", 20, "country"),
        ("Artist", "STRING", 20, "artist_name"), ("Song", "STRING", 30, "song_name"), ("Points", "INTEGER", None, "final_total_points"),
    ], None),
    "Ciudades": ([
        ("ID", "INTEGER", None, "#"), ("Ciudad", "STRING", 20, "City"), ("Lat", "FLOAT", None, "Latitude"), ("Lon", "FLOAT", None, "Longitude"),
    ], ("Lat", "Lon")),
    "Contests": ([
        ("ID", "INTEGER", None, "#"), ("Year", "INTEGER", None, "year"), ("Host", "STRING", 20, "host"), ("Date", "STRING", 12, "date"),
        ("SemiPaises", "INTEGER", None, "semi_countries"), ("FinalistPaises", "INTEGER", None, "final_countries"),
        ("JuryVoters", "INTEGER", None, "jury_countries_voting_final"), ("TeleVoters", "INTEGER", None, "televote_countries_voting_final"),
    ], None),
    "Paises": ([
        ("ID", "INTEGER", None, "#"), ("Pais", "STRING", 25, "country"), ("Region", "STRING", 20, "region"),
    ], None),
}


def seed_demo(catalog: Catalog, files: Mapping[str, str]) -> list[str]:
    """Create the demonstration tables that do not exist yet from the files given for them, if those
    are there. Returns the names of those made."""
    made = []
    for table, (columns, spatial) in DEMO.items():
        path = files.get(table)
        if path is None or table in catalog.tables or not catalog.files.exists(path):
            continue
        raw = read_csv(catalog.spark, path)
        rows = with_row_numbers(raw, "__number")
        fields = [Field(name, kind, size) for name, kind, size, _ in columns]
        taken = [
            F.col("__number").cast("int").alias(f.name) if source == "#" else coerced(_column(source) if source in raw.columns else F.lit(""), f).alias(f.name)
            for f, (_, _, _, source) in zip(fields, columns, strict=True)
        ]
        catalog.create(Table(table, fields, key=spatial[0] if spatial else fields[0].name, spatial=spatial))
        catalog.append(table, rows.select(*taken))
        made.append(table)
    return made
