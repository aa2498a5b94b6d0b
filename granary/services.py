"""Journal, locks and measurements around statements. All of it lives on the driver."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame


class Journal:
    """A file of JSON lines, one per event of a transaction: BEGIN, WAITING, RESUMED, COMMIT, ROLLBACK.
    It starts empty. Without a path nothing is kept."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self._lock = threading.Lock()
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text("")

    def note(self, txn: str, status: str, operation: str, table: str, detail: str = "") -> None:
        if self.path is None:
            return
        line = {"time": time.time(), "txn": txn, "thread": threading.get_ident(), "status": status, "operation": operation, "table": table, "detail": detail}
        with self._lock, self.path.open("a") as f:
            f.write(json.dumps(line, ensure_ascii=False) + "\n")

    def lines(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path else []

    @contextmanager
    def transaction(self, operation: str, table: str) -> Iterator[str]:
        txn, began = uuid.uuid4().hex[:8], time.perf_counter()
        self.note(txn, "BEGIN", operation, table)
        try:
            yield txn
        except BaseException as e:
            self.note(txn, "ROLLBACK", operation, table, str(e)[:500])
            raise
        self.note(txn, "COMMIT", operation, table, f"{(time.perf_counter() - began) * 1000:.1f} ms")


class DeadlockError(RuntimeError):
    pass


class WaitGraph:
    """Who waits for whom. A wait that would close a circle is refused."""

    def __init__(self) -> None:
        self._waits: dict[int, set[int]] = {}
        self._guard = threading.Lock()

    def wait(self, waiter: int, holders: set[int]) -> None:
        with self._guard:
            reach, new = set(), holders - {waiter}
            while new:
                reach |= new
                new = set().union(*(self._waits.get(h, set()) for h in new)) - reach
            if waiter in reach:
                raise DeadlockError(f"{waiter} would wait for itself through {sorted(holders)}")
            self._waits[waiter] = holders - {waiter}

    def done(self, waiter: int) -> None:
        with self._guard:
            self._waits.pop(waiter, None)


class SharedLock:
    """Many readers or one writer, re-entrant, waiting writers first. timeout: seconds after which a wait is
    given up, or None."""

    def __init__(self, graph: WaitGraph | None = None, timeout: float | None = 5.0):
        self.graph, self.timeout = graph or WaitGraph(), timeout
        self._turn = threading.Condition()
        self._readers: Counter[int] = Counter()
        self._writer: int | None = None
        self._depth = self._queued = 0

    def free(self) -> bool:
        """Whether this thread could write at once."""
        me = threading.get_ident()
        with self._turn:
            return self._writer in (None, me) and not set(self._readers) - {me}

    @contextmanager
    def reading(self) -> Iterator[None]:
        me = threading.get_ident()
        with self._turn:
            # Who reads or writes already goes on; others let waiting writers pass.
            self._wait(me, lambda: self._writer in (None, me) and (not self._queued or me in self._readers or self._writer == me))
            self._readers[me] += 1
        try:
            yield
        finally:
            with self._turn:
                self._readers[me] -= 1
                if not self._readers[me]:
                    del self._readers[me]
                self._turn.notify_all()

    @contextmanager
    def writing(self) -> Iterator[None]:
        me = threading.get_ident()
        with self._turn:
            self._queued += 1
            try:
                self._wait(me, lambda: self._writer in (None, me) and not set(self._readers) - {me})
            finally:
                self._queued -= 1
                self._turn.notify_all()
            self._writer, self._depth = me, self._depth + 1
        try:
            yield
        finally:
            with self._turn:
                self._depth -= 1
                if not self._depth:
                    self._writer = None
                self._turn.notify_all()

    def _wait(self, me: int, free) -> None:
        end = None if self.timeout is None else time.monotonic() + self.timeout
        try:
            while not free():
                holders = set(self._readers) | ({self._writer} if self._writer is not None else set())
                self.graph.wait(me, holders)
                left = None if end is None else max(0.0, end - time.monotonic())
                if not self._turn.wait(left) and end is not None and time.monotonic() >= end:
                    raise DeadlockError(f"no lock within {self.timeout} s")
        finally:
            self.graph.done(me)


class TableLocks:
    """One writer at a time for each table; readers need no lock, as versions never change. Sessions of
    one process that give the same scope, a workspace's path, share their locks. A wait that would never
    end, as its holder waits for this thread in turn, is refused; others have no limit unless given one."""

    _shared: dict[str, tuple[dict[str, SharedLock], WaitGraph]] = {}
    _guard = threading.Lock()

    def __init__(self, journal: Journal, scope: str | None = None, timeout: float | None = None):
        self.journal, self.timeout = journal, timeout
        with TableLocks._guard:
            self._locks, self._graph = TableLocks._shared.setdefault(scope, ({}, WaitGraph())) if scope else ({}, WaitGraph())

    @contextmanager
    def writing(self, table: str, txn: str = "-") -> Iterator[None]:
        with TableLocks._guard:
            lock = self._locks.setdefault(table, SharedLock(self._graph, self.timeout))
        waited = not lock.free()
        if waited:
            self.journal.note(txn, "WAITING", "write lock", table)
        with lock.writing():
            if waited:
                self.journal.note(txn, "RESUMED", "write lock", table)
            yield


@dataclass
class Telemetry:
    """What a program of statements took: wall time, what its queries read, by Spark's metrics, and what its
    changes wrote."""

    elapsed_ms: float = 0.0
    files_read: int = 0
    bytes_read: int = 0
    rows_scanned: int = 0
    files_written: int = 0
    bytes_written: int = 0
    rows_written: int = 0
    statements: int = 0

    def add(self, df: DataFrame) -> None:
        """Add the scans of a DataFrame that has run."""
        for name, value in scan_metrics(df):
            if name == "numFiles":
                self.files_read += value
            elif name == "filesSize":
                self.bytes_read += value
            elif name == "numOutputRows":
                self.rows_scanned += value


def scan_metrics(df: DataFrame) -> list[tuple[str, int]]:
    """(metric, value) of each file scan of a DataFrame that has run."""
    return [(name, value) for kind, name, value in _metrics(df, {
        "FileSourceScanExec": ("numFiles", "filesSize", "numOutputRows"), "BatchScanExec": ("numFiles", "filesSize", "numOutputRows"),
    })]


def sort_metrics(df: DataFrame) -> dict[str, int]:
    """What the sorts of a DataFrame that has run took: rows, the runs they were dealt to (a run is one
    partition, sorted and merged by one task), bytes and records that the shuffles before them wrote, bytes
    that were spilled to disk, and peak memory."""
    names = {"shuffleRecordsWritten": "rows", "numPartitions": "runs", "shuffleBytesWritten": "bytes_written", "spillSize": "bytes_spilled", "peakMemory": "peak_memory"}
    out = dict.fromkeys(names.values(), 0)
    for _, name, value in _metrics(df, {"ShuffleExchangeExec": ("shuffleRecordsWritten", "shuffleBytesWritten", "numPartitions"), "SortExec": ("spillSize", "peakMemory")}):
        out[names[name]] = max(out[names[name]], value) if name in ("numPartitions", "peakMemory") else out[names[name]] + value
    return out


def _metrics(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> list[tuple[str, str, int]]:
    """(kind of node, metric, value) of the nodes of these kinds of a DataFrame that has run."""
    out: list[tuple[str, str, int]] = []
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
            plans.append(plan.plan())
            continue
        if kind in wanted:
            found = plan.metrics()
            out += [(kind, name, int(found.apply(name).value())) for name in wanted[kind] if found.contains(name)]
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return out


@dataclass
class QueryResult:
    """kind: table, spatial, message or error. df: a SELECT's DataFrame; more: whether rows were left
    behind because only some were to be fetched."""

    kind: str
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    spatial: dict | None = None
    message: str = ""
    telemetry: Telemetry = field(default_factory=Telemetry)
    df: DataFrame | None = None
    more: bool = False

    def to_dict(self) -> dict:
        return {"kind": self.kind, "columns": self.columns, "rows": self.rows, "spatial": self.spatial, "message": self.message, "telemetry": vars(self.telemetry)}


def summary(messages: Sequence[tuple[str, str, int]]) -> str:
    """messages: (operation, text or table, rows). One stays as it is; of several, the inserts and the
    deletes of each table become one line each, and come first."""
    if not messages:
        return "OK"
    counts = {"insert": Counter(), "delete": Counter()}
    others = []
    for operation, text, rows in messages:
        if operation in counts:
            counts[operation][text] += rows
        else:
            others.append(text)
    if len(messages) == 1 and messages[0][0] == "insert":
        return f"1 row inserted into '{messages[0][1]}'"
    lines = [f"{n} row(s) inserted into '{t}'" for t, n in counts["insert"].items()]
    lines += [f"{n} row(s) deleted from '{t}'" for t, n in counts["delete"].items()]
    return "\n".join([*lines, *others])
