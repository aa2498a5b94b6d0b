"""Measurements as CSV files, and a report made of them.

A measurement is a row (group, measure, rows, seconds). Files are written and read through Hadoop's file
systems, so they may be wherever a workspace may be. The report is Markdown: a template with a table and
bars for each group, and the fastest measure of each named in its summary.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass, fields

from granary.errors import AnalysisError
from granary.sources.files import Files

BAR = 40
TEMPLATE = """# Measurements

{summary}

{groups}"""


@dataclass(frozen=True)
class Measurement:
    group: str
    measure: str
    rows: int
    seconds: float


def write_csv(files: Files, path: str, rows: Iterable[Measurement]) -> None:
    """A header and one line a measurement, in their order."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([f.name for f in fields(Measurement)])
    writer.writerows(astuple(r) for r in rows)
    files.write(path, out.getvalue())


def read_csv(files: Files, path: str) -> list[Measurement]:
    found = csv.DictReader(io.StringIO(files.read(path)))
    return [Measurement(r["group"], r["measure"], int(r["rows"]), float(r["seconds"])) for r in found]


def render(rows: Sequence[Measurement]) -> str:
    """The report's text."""
    groups: dict[str, list[Measurement]] = {}
    for r in rows:
        groups.setdefault(r.group, []).append(r)
    summary, parts = [], []
    for group, members in groups.items():
        best, worst = min(members, key=lambda r: r.seconds), max(members, key=lambda r: r.seconds)
        summary.append(f"* {group}: {best.measure} is fastest with {best.seconds:.4g} s.")
        lines = [f"## {group}", "", "| Measure | Rows | Seconds | |", "| --- | ---: | ---: | --- |"]
        for r in members:
            bar = "█" * max(1, round(BAR * r.seconds / worst.seconds)) if worst.seconds > 0 else ""
            lines.append(f"| {r.measure} | {r.rows} | {r.seconds:.4g} | {bar} |")
        parts.append("\n".join(lines))
    return TEMPLATE.format(summary="\n".join(summary), groups="\n\n".join(parts)) + "\n"


def generate(files: Files, sources: Sequence[str], path: str) -> int:
    """Write the report of the CSV files that exist among sources; none is an error. Returns the number of
    measurements."""
    found = [r for s in sources if files.exists(s) for r in read_csv(files, s)]
    if not found:
        raise AnalysisError(f"no measurements in {', '.join(sources)}")
    files.write(path, render(found))
    return len(found)
