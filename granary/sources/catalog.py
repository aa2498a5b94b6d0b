"""Workspaces and the catalog of tables in each.

A workspace is a folder with manifests and one folder a table. A table's rows are in Parquet files that
never change; the newest manifest names those of its present version. INSERT adds a folder of files,
DELETE writes only the files that hold matching rows anew, small additions are merged with others of
their size, and each change becomes visible when the next manifest is written: a reader sees one
version, and what fails half way is never seen. Files of old versions stay until ``vacuum``, so that
queries that began before still find them.

Manifests are numbered, and a number is written once. Whoever finds the next one taken reads it and
makes the change again on what it says, so sessions that write at the same time lose nothing.
"""

from __future__ import annotations

import json
import struct
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError
from granary.functions.types import Field, converted, cut_bytes, schema_of
from granary.sources import layout
from granary.sources.files import Files

#: So many additions of one tier are merged into one. A tier ends at so many rows; what is larger than the
#: last is left alone. So a row is rewritten a few times at most, however many additions follow it.
COMPACT_AFTER = 50
TIERS = (50_000, 2_500_000, 125_000_000)
#: Manifests of older versions that stay for readers which have just found them.
OLD_MANIFESTS = 20
#: Tables of the hash layout whose folders are listed once, not at each lookup.
KNOWN_FOLDERS = 4096
DEFAULT_WORKSPACE = "default_testing"
_GUARDS: dict[str, threading.RLock] = defaultdict(threading.RLock)


class Conflict(RuntimeError):
    """The files that a change started from are no longer those of the table."""


@dataclass(frozen=True)
class Part:
    """A folder of files, or those of its files that still count, by their paths below it; rows: how many
    the folder had when it was written; buckets: the folders of its hash layout."""

    path: str
    files: list[str] | None = None
    rows: int = 0
    buckets: int = layout.BUCKETS

    def to_json(self) -> dict:
        return {"path": self.path, "rows": self.rows, "buckets": self.buckets} | ({"files": self.files} if self.files is not None else {})

    @property
    def tier(self) -> int:
        return next((i for i, most in enumerate(TIERS) if self.rows < most), len(TIERS))


@dataclass(frozen=True)
class Table:
    """kind: SEQUENTIAL, BTREE or HASH; key: the column of its layout; spatial: the X and Y column;
    marks: how far each of its streams has been loaded."""

    name: str
    fields: list[Field]
    kind: str = "SEQUENTIAL"
    key: str = ""
    spatial: tuple[str, str] | None = None
    parts: list[Part] = field(default_factory=list)
    marks: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {
            "fields": [{"name": f.name, "type": f.type} | ({"size": f.size} if f.size else {}) for f in self.fields],
            "layout": self.kind, "key": self.key, "spatial": self.spatial, "parts": [p.to_json() for p in self.parts], "marks": self.marks,
        }

    @staticmethod
    def from_json(name: str, found: dict) -> Table:
        fields = [Field(f["name"], f["type"], f.get("size")) for f in found["fields"]]
        spatial = tuple(found["spatial"]) if found["spatial"] else None
        return Table(name, fields, found["layout"], found["key"], spatial, [Part(**p) for p in found["parts"]], found.get("marks", {}))


class Workspaces:
    """The workspaces under a root folder. Their tables are apart from each other's."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark), root.rstrip("/")

    def names(self) -> list[str]:
        return [name for name, is_folder, _ in self.files.children(self.root) if is_folder]

    def path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise AnalysisError(f"no workspace can be called {name!r}")
        return f"{self.root}/{name}"

    def ensure(self, name: str = DEFAULT_WORKSPACE) -> str:
        path = self.path(name)
        self.files.make_dir(path)
        return path


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.manifests = f"{self.path}/_manifests"
        self.files.make_dir(self.manifests)
        self.tables: dict[str, Table] = {}
        self.version = 0
        self._scans: dict[str, tuple[Table, DataFrame]] = {}
        self._known: dict[str, tuple[Table, list[tuple[int, DataFrame]]]] = {}
        #: How many additions of a tier are merged, if not COMPACT_AFTER.
        self.compact_after: int | None = None
        #: What this catalog has written: files, bytes and rows.
        self.written = {"files": 0, "bytes": 0, "rows": 0}
        self.refresh()

    def refresh(self) -> None:
        """See what other sessions have changed."""
        for _ in range(5):
            names = [n for n, _, _ in self.files.children(self.manifests) if n.endswith(".json") and n[:-5].isdigit()]
            newest = max((int(n[:-5]) for n in names), default=0)
            if newest == self.version:
                return
            try:
                found = json.loads(self.files.read(self._manifest(newest)))
            except Py4JJavaError:  # so old by now that it is gone
                continue
            # A table that has not changed stays the same object.
            fresh = {name: Table.from_json(name, t) for name, t in found["tables"].items()}
            self.tables = {name: self.tables[name] if self.tables.get(name) == t else t for name, t in fresh.items()}
            self.version = newest
            return

    def _manifest(self, version: int) -> str:
        return f"{self.manifests}/{version:012d}.json"

    def _commit(self, change: Callable[[dict[str, Table]], dict[str, Table]]) -> None:
        """Make a change of the newest version the next one. change is called again on what others have
        written in between, and raises where it no longer applies."""
        with _GUARDS[self.path]:
            while True:
                self.refresh()
                tables = change(self.tables)
                text = json.dumps({"tables": {k: t.to_json() for k, t in tables.items()}}, ensure_ascii=False, indent=1)
                if self.files.create(self._manifest(self.version + 1), text):
                    break
        self.tables, self.version = tables, self.version + 1
        self.files.remove(self._manifest(self.version - OLD_MANIFESTS))

    def _update(self, name: str, change: Callable[[Table], Table]) -> None:
        self._commit(lambda tables: {**tables, name: change(self._in(tables, name))})

    @staticmethod
    def _in(tables: dict[str, Table], name: str) -> Table:
        if name not in tables:
            raise AnalysisError(f"Table '{name}' not found")
        return tables[name]

    def _swap(self, name: str, old: list[Part], new: list[Part]) -> None:
        """Put new parts in the place of old ones, which must still be there as they were."""

        def change(table: Table) -> Table:
            now = {p.path: p for p in table.parts}
            if any(now.get(p.path) != p for p in old):
                raise Conflict(name)
            gone = {p.path for p in old}
            return replace(table, parts=[*(p for p in table.parts if p.path not in gone), *new])

        self._update(name, change)

    def table(self, name: str) -> Table:
        return self._in(self.tables, name)

    def create(self, table: Table) -> None:
        names = [f.name for f in table.fields]
        if len(set(names)) < len(names):
            raise AnalysisError(f"table {table.name!r} has two columns of one name")
        for column in (table.key, *(table.spatial or ())):
            if column not in names:
                raise AnalysisError(f"table {table.name!r} has no column {column!r}")

        def change(tables: dict[str, Table]) -> dict[str, Table]:
            if table.name in tables:
                raise AnalysisError(f"Table '{table.name}' already exists")
            return {**tables, table.name: table}

        self._commit(change)

    def set_spatial(self, name: str, pair: tuple[str, str]) -> None:
        """Give a table without a spatial layout one; its rows are ordered by the next compaction."""
        if self.table(name).spatial is None and set(pair) <= {f.name for f in self.table(name).fields}:
            self._update(name, lambda t: replace(t, spatial=t.spatial or pair))

    # Rows.

    def read(self, name: str, bucket_key: object = None) -> DataFrame:
        """The rows of a table. bucket_key: a value of the key; with a hash layout only its folders are read."""
        table = self.table(name)
        if table.kind == "HASH" and bucket_key is not None and table.parts:
            own = next(f for f in table.fields if f.name == table.key)
            try:
                hashed = self._hash(converted(bucket_key, own), own.type)
            except AnalysisError:
                hashed = None  # a value that the key cannot have: the condition itself finds nothing
            if hashed is not None:
                return self._folders(table, hashed)
        # Files never change, so what Spark knows of a version's files stays true.
        known, df = self._scans.get(name, (None, None))
        if known is not table:
            df = self._scan(table, table.parts).select(*[F.col(f"`{f.name}`") for f in table.fields])
            self._scans[name] = table, df
        return df

    def _hash(self, value: object, kind: str) -> int | None:
        """The hash by which ``layout.bucket_of`` deals a key, or None where only Spark itself can tell."""
        if kind == "FLOAT":
            return None
        raw = str(value).encode() if kind == "STRING" else struct.pack("<i" if kind == "INTEGER" else "<q", value)
        spark = self.spark.sparkContext._jvm.org.apache.spark
        return spark.sql.catalyst.expressions.XXH64.hashUTF8String(spark.unsafe.types.UTF8String.fromBytes(bytearray(raw)), 42)

    def _folders(self, table: Table, hashed: int) -> DataFrame:
        """The rows of the one folder of each part that a key may be in. What Spark knows of a small table's
        folders is kept and pruned; of a large one only the folder itself is listed."""
        if sum(p.buckets for p in table.parts) <= KNOWN_FOLDERS:
            known, frames = self._known.get(table.name, (None, []))
            if known is not table:
                frames = [(p.buckets, self._scan(table, [p])) for p in table.parts]
                self._known[table.name] = table, frames
            found = [df.where(F.col(layout.BUCKET) == hashed % buckets) for buckets, df in frames]
            return reduce(DataFrame.unionByName, found).drop(layout.BUCKET)
        paths = []
        for part in table.parts:
            folder = f"{layout.BUCKET}={hashed % part.buckets}"
            if part.files is not None:
                paths += [f"{self.path}/{part.path}/{f}" for f in part.files if f.startswith(f"{folder}/")]
            elif self.files.exists(f"{self.path}/{part.path}/{folder}"):
                paths.append(f"{self.path}/{part.path}/{folder}")
        if not paths:
            return self.spark.createDataFrame([], schema_of(table.fields))
        return self.spark.read.schema(schema_of(table.fields)).parquet(*paths)

    def _scan(self, table: Table, parts: list[Part], file: str | None = None) -> DataFrame:
        """The rows of some parts, with their file's path in a column if it gets a name."""
        schema = schema_of(table.fields)
        if table.kind == "HASH":
            schema = T.StructType([*schema.fields, T.StructField(layout.BUCKET, T.IntegerType())])
        if not parts:
            df = self.spark.createDataFrame([], schema)
            return df.withColumn(file, F.lit("")) if file else df
        frames = []
        # Buckets are in the names of folders, which count from each part's own.
        for group in [[p] for p in parts] if table.kind == "HASH" else [parts]:
            reader = self.spark.read.schema(schema)
            if table.kind == "HASH":
                reader = reader.option("basePath", f"{self.path}/{group[0].path}")
            df = reader.parquet(*[x for p in group for x in self._paths(p)])
            frames.append(df.select("*", F.col("_metadata.file_path").alias(file)) if file else df)
        return reduce(DataFrame.unionByName, frames)

    def _paths(self, part: Part) -> list[str]:
        folder = f"{self.path}/{part.path}"
        return [folder] if part.files is None else [f"{folder}/{f}" for f in part.files]

    def _files(self, part: Part) -> list[str]:
        """The files of a part, by their paths below its folder."""
        if part.files is not None:
            return part.files
        out, folders = [], [""]
        while folders:
            below = folders.pop()
            for n, is_folder, _ in self.files.children(f"{self.path}/{part.path}/{below}"):
                if is_folder:
                    folders.append(f"{below}{n}/")
                elif n.endswith(".parquet"):
                    out.append(f"{below}{n}")
        return sorted(out)

    def _write(self, table: Table, df: DataFrame, rows: int) -> Part:
        """Write rows in the table's layout."""
        part = Part(f"{table.name}/{uuid.uuid4().hex}", rows=rows, buckets=layout.buckets_for(rows))
        layout.writer(layout.arranged(df, table.kind, table.key, table.spatial, rows)).parquet(f"{self.path}/{part.path}")
        self._note(part.path, rows)
        return part

    def _note(self, folder: str, rows: int) -> None:
        """Count what has been written."""
        files, size = self.files.total(f"{self.path}/{folder}")
        for k, v in (("files", files), ("bytes", size), ("rows", rows)):
            self.written[k] += v

    def append_values(self, name: str, rows: Sequence[Sequence[object]]) -> None:
        """Literal rows, in one addition."""
        table = self.table(name)
        for row in rows:
            if len(row) != len(table.fields):
                raise AnalysisError(f"INSERT: {len(row)} values for {len(table.fields)} columns")
        made = [[converted(v, f) for v, f in zip(row, table.fields, strict=True)] for row in rows]
        df = self.spark.createDataFrame(made, schema_of(table.fields)).coalesce(1)
        part = Part(f"{table.name}/{uuid.uuid4().hex}", rows=len(rows))
        if table.kind == "HASH":
            df = df.withColumn(layout.BUCKET, layout.bucket_of(F.col(table.key), part.buckets))
        layout.writer(df).parquet(f"{self.path}/{part.path}")
        self._note(part.path, len(rows))
        self._add(name, part)

    def _add(self, name: str, part: Part, mark: tuple[str, int] | None = None) -> None:
        """Make an addition visible, then merge what has gathered in a tier."""
        marks = dict([mark] if mark else [])
        self._update(name, lambda t: replace(t, parts=[*t.parts, part], marks=t.marks | marks))
        for tier in range(len(TIERS)):
            found = [p for p in self.table(name).parts if p.tier == tier]
            if len(found) >= (self.compact_after or COMPACT_AFTER):
                try:
                    self._merge(name, found)
                except Conflict:
                    return  # another session is at it

    def append(self, name: str, df: DataFrame, mark: tuple[str, int] | None = None, progress: Callable[[int, int], None] | None = None) -> int:
        """Rows of a DataFrame with the table's columns, laid out as the table is. Returns their number.
        mark: a stream and the number of its batch; both become visible at once with the rows, and a
        batch that is marked already is not loaded again. progress: called with rows done and all rows."""
        self.refresh()
        table = self.table(name)
        if mark and table.marks.get(mark[0], -1) >= mark[1]:
            return 0
        cut = [cut_bytes(F.col(f.name), f.size).alias(f.name) if f.size else F.col(f.name).cast(f.struct_field().dataType) for f in table.fields]
        df = df.select(*cut)
        # Written once as it comes: what follows, counts and bounds, then reads Parquet, not the source.
        raw = f"{self.path}/{table.name}/{uuid.uuid4().hex}"
        df.write.parquet(raw)
        loaded = self.spark.read.schema(schema_of(table.fields)).parquet(raw)
        n = loaded.count()
        with watched(self.spark, n, progress):
            part = self._write(table, loaded, n)
        self.files.remove(raw)
        self._add(name, part, mark)
        return n

    def _merge(self, name: str, parts: list[Part]) -> None:
        """Write some parts as one."""
        table = self.table(name)
        rows = self._scan(table, parts).select(*[F.col(f"`{f.name}`") for f in table.fields])
        n = sum(p.rows for p in parts) if all(p.files is None for p in parts) else rows.count()
        self._swap(name, parts, [self._write(table, rows, n)])

    def compact(self, name: str) -> None:
        """Write all of a table in its layout."""
        self._retried(lambda: self._merge(name, self.table(name).parts) if self.table(name).parts else None)

    def _retried(self, run: Callable[[], int | None]) -> int | None:
        for _ in range(9):
            try:
                self.refresh()
                return run()
            except Conflict:
                pass
        self.refresh()
        return run()

    def count(self, name: str) -> int:
        return self.read(name).count()

    def delete(self, name: str, matches: Column | None) -> int:
        """Remove the rows that match, or all. Only files that hold such rows are written anew. Returns
        how many rows are gone; none gone leaves the version as it is. Rows that another session adds
        meanwhile stay; if it changes the files that hold matches, the search begins anew."""
        return self._retried(lambda: self._deleted(self.table(name), matches)) or 0

    def _deleted(self, table: Table, matches: Column | None) -> int:
        file = "__file"
        if matches is None:
            n = self.count(table.name)
            if n:
                self._swap(table.name, table.parts, [])
            return n
        rows = self._scan(table, table.parts, file).alias(table.name)
        # As many rows as files that hold a match; each is looked up among the parts by its folder's name.
        hit = rows.where(matches).groupBy(file).agg(F.count(F.lit(1)).alias("n")).collect()
        if not hit:
            return 0
        by_folder: dict[str, set[str]] = defaultdict(set)
        for r in hit:
            folder, _, below = unquote(r[file]).rpartition(f"/{table.name}/")[2].partition("/")
            by_folder[f"{table.name}/{folder}"].add(below)
        old, touched, new = [], [], []
        for part in table.parts:
            mine = by_folder.get(part.path)
            if mine:
                old.append(part)
                touched.append(replace(part, files=sorted(mine)))
                left = [f for f in self._files(part) if f not in mine]
                if left:
                    new.append(replace(part, files=left))
        keep = self._scan(table, touched).alias(table.name).where(~F.coalesce(matches, F.lit(False))).select(*[F.col(f"`{f.name}`") for f in table.fields])
        n = keep.count()
        if n:
            new.append(self._write(table, keep, n))
        self._swap(table.name, old, new)
        return sum(r["n"] for r in hit)

    def vacuum(self, name: str) -> int:
        """Remove folders of old versions; only while nothing reads them."""
        table = self.table(name)
        current = {p.path.split("/")[-1] for p in table.parts}
        old = [n for n, is_folder, _ in self.files.children(f"{self.path}/{name}") if is_folder and n not in current]
        for n in old:
            self.files.remove(f"{self.path}/{name}/{n}")
        return len(old)

    # Descriptions.

    def list_tables(self) -> DataFrame:
        """One row per table, in order of creation."""
        rows = [(i, t.name, t.kind, t.key, len(t.parts)) for i, t in enumerate(self.tables.values())]
        return self.spark.createDataFrame(rows, "position int, name string, layout string, key string, parts int")

    def describe(self, name: str) -> DataFrame:
        rows = [(i, f.name, f.type, f.size) for i, f in enumerate(self.table(name).fields)]
        return self.spark.createDataFrame(rows, "position int, column string, type string, size int")

    def inspect(self, name: str) -> DataFrame:
        """Files of the present version with their rows."""
        rows = self._scan(self.table(name), self.table(name).parts, "file")
        return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))

    def row_groups(self, name: str, columns: Sequence[str]) -> DataFrame:
        """The row groups of the present version's files: file, row_group, rows, and for each column named the
        least and the largest value (low_<column>, high_<column>), as the files' footers give them."""
        table = self.table(name)
        jvm, found = self.spark.sparkContext._jvm, []
        for part in table.parts:
            for file in self._files(part):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part.path}/{file}")
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, self.files.conf))
                try:
                    for i, block in enumerate(reader.getFooter().getBlocks()):
                        known = {c.getPath().toDotString(): c.getStatistics() for c in block.getColumns()}
                        some = [known[c] if c in known and known[c].hasNonNullValue() else None for c in columns]
                        values = [float(v) if v is not None else None for k in some for v in ((k.genericGetMin(), k.genericGetMax()) if k else (None, None))]
                        found.append((f"{part.path}/{file}", i, int(block.getRowCount()), *values))
                finally:
                    reader.close()
        kinds = ", ".join(f"`low_{c}` double, `high_{c}` double" for c in columns)
        return self.spark.createDataFrame(found, f"file string, row_group int, rows bigint, {kinds}")


@contextmanager
def watched(spark: SparkSession, rows: int, progress: Callable[[int, int], None] | None, every: float = 0.2) -> Iterator[None]:
    """While a job of this thread writes rows, tell progress how many of them are done, about, by the tasks
    that have ended; and in the end that all are. One that raises ends the watching, not the job."""
    if progress is None:
        yield
        return
    over, tracker, group = threading.Event(), spark.sparkContext.statusTracker(), f"load-{uuid.uuid4().hex}"

    def look() -> None:
        last = -1
        while not over.wait(every):
            infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j) or ((), (), ()))[1]]
            tasks, ended = sum(i.numTasks for i in infos if i), sum(i.numCompletedTasks for i in infos if i)
            now = rows * ended // tasks if tasks else 0
            if now > last and now < rows:
                progress(now, rows)
                last = now

    before = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", group)
    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
    progress(rows, rows)
