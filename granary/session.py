"""Sessions: programs of statements over a workspace and over registered DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import AnalysisError
from granary.functions.types import converted, field_of
from granary.operators import predicates, spatial
from granary.operators.scope import Scope, Source
from granary.plans import nodes as n
from granary.plans.lower import lower_select
from granary.plans.parser import parse
from granary.services import Journal, QueryResult, TableLocks, Telemetry, summary
from granary.sources import csv_source
from granary.sources.catalog import Catalog, Table, Workspaces


#: Rows of a result that come to the driver unless the caller says otherwise.
FETCH = 100_000


class Session:
    """workspace: the folder of a workspace, or None for registered DataFrames only."""

    def __init__(self, spark: SparkSession, workspace: str | None = None, journal: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, workspace) if workspace else None
        self.journal = Journal(journal)
        self.locks = TableLocks(self.journal, workspace and workspace.rstrip("/"))
        self._frames: dict[str, tuple[DataFrame, tuple[str, str] | None]] = {}
        self._loads: dict[str, Callable[[], DataFrame]] = {}
        self._pending: dict[str, list[tuple[object, ...]]] = {}
        self._folder: str | None = None

    @staticmethod
    def open(spark: SparkSession, root: str, name: str | None = None, **options) -> Session:
        """A session in a workspace under root, which is made if there is none."""
        spaces = Workspaces(spark, root)
        return Session(spark, spaces.ensure(name) if name else spaces.ensure(), **options)

    @staticmethod
    def over(spark: SparkSession, folder: str, tables: Mapping[str, str] | None = None) -> Session:
        """A session over the Parquet tables of a folder, each read when a statement names it."""
        session = Session(spark)
        session._folder = folder
        for name, path in (tables or {}).items():
            session._loads[name] = lambda path=path: spark.read.parquet(path)
        return session

    def register(self, name: str, df: DataFrame, spatial: tuple[str, str] | None = None) -> None:
        """Let statements use a DataFrame as a table; spatial: its X and Y column."""
        self._frames[name] = (df, spatial)

    # Tables.

    def table(self, name: str, bucket_key: object = None) -> DataFrame:
        self._refreshed()
        return self._source(name, None, bucket_key).df

    def _refreshed(self) -> None:
        """See what other sessions have changed."""
        if self.catalog:
            self.catalog.refresh()

    def _source(self, name: str, alias: str | None, bucket_key: object = None) -> Source:
        if name in self._frames:
            df, pair = self._frames[name]
            return Source(name, alias, df, pair)
        if self.catalog and name in self.catalog.tables:
            table = self.catalog.table(name)
            return Source(name, alias, self.catalog.read(name, bucket_key), table.spatial, table.key)
        if name in self._loads:
            return Source(name, alias, self._loads[name]())
        if self._folder and name.isidentifier():
            try:
                return Source(name, alias, self.spark.read.parquet(f"{self._folder}/{name}.parquet"))
            except AnalysisException as e:
                raise AnalysisError(f"Table '{name}' not found") from e
        raise AnalysisError(f"Table '{name}' not found")

    def lookup(self, table: str, key: object, column: str | None = None) -> DataFrame:
        """The first row whose key is this; by default the key of the table's layout."""
        self._refreshed()
        known = self.catalog.tables.get(table) if self.catalog and table not in self._frames else None
        source = self._source(table, None, key if known and column in (None, known.key) else None)
        column = column or source.key or source.columns[0]
        if column not in source.columns:
            raise AnalysisError(f"unknown column {column!r}")
        scope = Scope.of(source)
        found = predicates.compare(scope, n.Compare(n.Name(column), "=", key))
        return source.df.alias(source.label).where(found).limit(1)

    def range_search(self, table: str, low: object, high: object, column: str | None = None) -> DataFrame:
        """The rows whose key is from low to high, both included, in its order."""
        self._refreshed()
        source = self._source(table, None)
        column = column or source.key or source.columns[0]
        found = predicates.condition(Scope.of(source), n.Between(n.Name(column), low, high))
        return source.df.alias(source.label).where(found).orderBy(F.col(f"`{column}`"))

    # Statements.

    def sql_df(self, sql: str, strategy: str = "auto") -> DataFrame:
        """The DataFrame of one SELECT, not yet run. strategy: of its join."""
        statements = parse(sql)
        if len(statements) != 1 or not isinstance(statements[0], n.Select):
            raise AnalysisError("sql_df takes one SELECT")
        return self._select(statements[0], strategy)

    def _select(self, s: n.Select, strategy: str = "auto") -> DataFrame:
        self._flush()
        self._refreshed()
        bucket_key = None
        if self.catalog and s.table in self.catalog.tables and s.join is None:
            bucket_key = predicates.equals(s.where, self.catalog.table(s.table).key)
        sources = [self._source(s.table, s.alias, bucket_key)]
        if s.join is not None:
            sources.append(self._source(s.join.table, s.join.alias))
        return lower_select(s, tuple(sources), strategy)

    def execute(self, sql: str, fetch: int | None = FETCH) -> QueryResult:
        """Run a program and return what its last SELECT found, or what its statements say. All are
        parsed before any runs; one that fails leaves no trace, those before it stand. fetch: bring at
        most so many rows of a result to the driver, or all with None; the result says whether there are
        more, and its df, like that of any SELECT, has all of them and can go on to a sink without passing
        through the driver."""
        if not sql.strip():
            return QueryResult("message", message="Empty query")
        began, telemetry = time.perf_counter(), Telemetry()
        try:
            result = self._run(sql, telemetry, fetch)
        except Exception as e:
            result = QueryResult("error", message=str(e).split("\n\nJVM stacktrace")[0])
        telemetry.elapsed_ms = (time.perf_counter() - began) * 1000
        result.telemetry = telemetry
        return result

    def _run(self, sql: str, telemetry: Telemetry, fetch: int | None) -> QueryResult:
        messages: list[tuple[str, str, int]] = []
        found: QueryResult | None = None
        written = dict(self.catalog.written) if self.catalog else {}
        try:
            for statement in parse(sql):
                telemetry.statements += 1
                if isinstance(statement, n.Select):
                    df = self._select(statement)
                    taken = df if fetch is None else df.limit(fetch + 1)
                    rows = [r.asDict() for r in taken.collect()]
                    telemetry.add(taken)
                    more = fetch is not None and len(rows) > fetch
                    found = QueryResult("table", df.columns, rows[:fetch], df=df, more=more)
                    if isinstance(statement.where, n.Near) and statement.join is None:
                        found = self._spatial_result(statement, found, fetch)
                elif isinstance(statement, n.Insert):
                    self._insert(statement)
                    messages.append(("insert", statement.table, 1))
                elif isinstance(statement, n.Delete):
                    gone = self._delete(statement)
                    messages.append(("delete", statement.table, gone))
                else:
                    messages.append(("create", self._create(statement), 0))
        finally:
            self._flush()
            for k, before in written.items():
                setattr(telemetry, f"{k}_written", self.catalog.written[k] - before)
        return found or QueryResult("message", message=summary(messages))

    def _spatial_result(self, s: n.Select, found: QueryResult, fetch: int | None) -> QueryResult:
        near: n.Near = s.where  # type: ignore[assignment]
        hits, points = self.spatial_search(s.table, near)
        if fetch is not None:
            hits = hits.limit(fetch)
        form = {"cx": near.x, "cy": near.y} | ({"k": near.k} if near.k is not None else {"radius": near.radius})
        payload = form | {"results": [r.asDict() for r in hits.collect()], "all_points": points}
        return QueryResult("spatial", found.columns, found.rows, payload, df=found.df, more=found.more)

    def spatial_search(self, table: str, near: n.Near) -> tuple[DataFrame, DataFrame]:
        """(hits with their distance, nearest first; all points) of a table with a spatial layout. Points
        are labelled by the first string column."""
        source = self._source(table, None)
        pair = source.spatial or ("", "")
        texts = [f.name for f in source.df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in pair]
        key = source.columns[0]
        hits, points = spatial.payload(source, near, key, texts[0] if texts else key)
        return hits.orderBy("distance", "id"), points

    # Changes.

    def _need_catalog(self) -> Catalog:
        if self.catalog is None:
            raise AnalysisError("this session has no workspace to change")
        return self.catalog

    def _create(self, c: n.Create) -> str:
        catalog = self._need_catalog()
        self._flush()
        if c.table in catalog.tables:
            return f"Table '{c.table}' already exists"
        fields = [field_of(x.name, x.type, x.size) for x in c.columns]
        kind, key, pair = "SEQUENTIAL", fields[0].name, None
        if c.layouts:
            chosen = c.layouts[0]
            kind, key = chosen.kind, chosen.column
            if kind == "RTREE":
                kind, pair = "SEQUENTIAL", (key, chosen.second or self._companion(fields, key))
        with self.journal.transaction("CREATE", c.table) as txn, self.locks.writing(c.table, txn):
            if c.table in (catalog.refresh() or catalog.tables):
                return f"Table '{c.table}' already exists"
            catalog.create(Table(c.table, fields, kind, key, pair))
        if c.path is None:
            return f"Table '{c.table}' created"
        path = self._csv_path(c.path)
        return f"Table '{c.table}' created and loaded {self.ingest(path, c.table)} rows from '{path}'"

    @staticmethod
    def _companion(fields, key: str) -> str:
        """The Y column that goes with X: the first FLOAT after it."""
        names = [f.name for f in fields]
        if key not in names:
            raise AnalysisError(f"no column {key!r} for the spatial layout")
        for f in fields[names.index(key) + 1 :]:
            if f.type == "FLOAT":
                return f.name
        raise AnalysisError(f"no FLOAT column follows {key!r} for the spatial layout")

    def _csv_path(self, path: str) -> str:
        catalog = self._need_catalog()
        if path.startswith("/") or "://" in path or catalog.files.exists(path):
            return path
        parent = catalog.path.rpartition("/")[0]
        for folder in (catalog.path, "data", f"{parent}/data"):
            if catalog.files.exists(f"{folder}/{path}"):
                return f"{folder}/{path}"
        return path

    def _insert(self, i: n.Insert) -> None:
        """Rows wait until another statement or the program's end, and are then written together; what
        is wrong with a row is found at once."""
        catalog = self._need_catalog()
        if i.table not in self._pending:
            catalog.refresh()
        table = catalog.table(i.table)
        with self.journal.transaction("INSERT", i.table):
            if len(i.values) != len(table.fields):
                raise AnalysisError(f"INSERT: {len(i.values)} values for {len(table.fields)} columns")
            for value, f in zip(i.values, table.fields, strict=True):
                converted(value, f)
        self._pending.setdefault(i.table, []).append(i.values)

    def _flush(self) -> None:
        for table, rows in list(self._pending.items()):
            del self._pending[table]
            with self.journal.transaction("APPEND", table) as txn, self.locks.writing(table, txn):
                self._need_catalog().append_values(table, rows)

    def _delete(self, d: n.Delete) -> int:
        catalog = self._need_catalog()
        self._flush()
        catalog.refresh()
        catalog.table(d.table)
        with self.journal.transaction("DELETE", d.table) as txn, self.locks.writing(d.table, txn):
            source = self._source(d.table, None)
            return catalog.delete(d.table, None if d.where is None else predicates.condition(Scope.of(source), d.where))

    def ingest(
        self, path: str, table: str, progress=None, spatial_columns: tuple[str, str] | None = None, multi_line: bool = True
    ) -> int:
        """Load a CSV file; see ``csv_source.ingest``."""
        self._flush()
        self._refreshed()
        with self.journal.transaction("INGEST", table) as txn, self.locks.writing(table, txn):
            return csv_source.ingest(self._need_catalog(), path, table, progress, spatial_columns, multi_line)
