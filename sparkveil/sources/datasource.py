"""Audit events as a data source of Spark's: `spark.read.format("audit_events")`, and `readStream` likewise.

A folder of JSON lines by date, as `logs.write_events` writes it (`date=2024-01-31/part-*.json[.gz]`). Filters on the time skip
whole days before a file is opened, and all simple filters on columns drop rows where they are read. A stream's offset is the last file
in the order of times and names. Register with `spark.dataSource.register(AuditEvents)`; filters are pushed down where
`spark.sql.python.filterPushdown.enabled` is true.
"""

from __future__ import annotations

import gzip
import io
import json
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyarrow import fs as pafs
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from ..schemas import AUDIT_TABLE

DATE = re.compile(r"date=(\d{4}-\d{2}-\d{2})/")
COMPARE = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
ONE_DAY = timedelta(days=1)
BATCH = 1000


@dataclass
class File(D.InputPartition):
    path: str
    modified: int


def listed(path: str) -> list[File]:
    """The data files under a folder, by time and name; hidden ones and those being written are left out."""
    system, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if system.get_file_info(root).type == pafs.FileType.NotFound:
        return []
    found = system.get_file_info(pafs.FileSelector(root, recursive=True))
    names = [(f.mtime_ns or 0, f.path) for f in found if f.is_file and not re.search(r"(^|/)[._]", f.path[len(root) :])]
    return [File(p, t) for t, p in sorted(names)]


def row_of(event: dict) -> dict:
    """An event's columns as those of the audit table."""
    context = event.get("context") or {}
    at = event.get("timestamp")
    out = {k: v for k, v in context.items() if k in AUDIT_TABLE.names}
    out |= {k: event.get(k) for k in ("id", "event_type", "severity", "message")}
    out["timestamp"] = datetime.fromisoformat(at.replace("Z", "+00:00")).astimezone(timezone.utc) if at else None
    out["metadata"] = json.dumps(event["metadata"], sort_keys=True) if event.get("metadata") else None
    return out


def _utc(x):
    return x.replace(tzinfo=timezone.utc) if isinstance(x, datetime) and x.tzinfo is None else x


def holds(f: D.Filter, row: dict) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, D.IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(f, D.In):
        return value in [_utc(x) for x in f.value]
    return isinstance(f, D.IsNotNull) or COMPARE[type(f)](value, _utc(f.value))


def day_may_hold(f: D.Filter, day: date) -> bool:
    """Whether a day's events may pass a filter on the time."""
    if f.attribute != ("timestamp",) or isinstance(f, (D.IsNull, D.IsNotNull)):
        return True
    days = [_utc(x).astimezone(timezone.utc).date() for x in (f.value if isinstance(f, D.In) else [f.value])]
    if isinstance(f, (D.In, D.EqualTo)):
        return day in days
    return day >= days[0] if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)) else day <= days[0]


def read_file(path: str, base: str, schema: StructType, filters: Iterable[D.Filter]) -> Iterator[tuple]:
    """The rows of a file that pass the filters; lines that don't parse are left to `logs.parse_errors`."""
    system = pafs.FileSystem.from_uri(base)[0] if "://" in base else pafs.LocalFileSystem()
    with system.open_input_stream(path, compression=None) as raw:
        plain = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        for line in io.TextIOWrapper(io.BufferedReader(plain) if not isinstance(plain, gzip.GzipFile) else plain, "utf-8", "replace"):
            try:
                row = row_of(json.loads(line))
            except (ValueError, AttributeError, TypeError):
                continue
            if all(holds(f, row) for f in filters):
                yield tuple(row.get(n) for n in schema.names)


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if isinstance(f, (*COMPARE, D.In, D.IsNull, D.IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        """A file each, of the days that may hold a row."""
        dated = [(f, DATE.search(f.path)) for f in listed(self.path)]
        return [f for f, m in dated if m is None or all(day_may_hold(x, date.fromisoformat(m[1])) for x in self.filters)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        """A file's rows; without any file Spark asks once, for None."""
        return read_file(partition.path, self.path, self.schema, self.filters) if partition else iter(())


class StreamReader(D.DataSourceStreamReader):
    """Files in the order of their times and names; a file that appears later with an earlier time is not seen."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        place = lambda o: (o["modified"], o["path"])
        return [f for f in listed(self.path) if place(start) < (f.modified, f.path) <= place(end)]

    def read(self, partition: File) -> Iterator[tuple]:
        return read_file(partition.path, self.path, self.schema, ())

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class AuditEvents(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit_events"

    def schema(self) -> StructType:
        return AUDIT_TABLE

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)
