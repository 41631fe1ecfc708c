"""A web archive of tracks as a data source: its catalogue gives the partitions, filters on tags and times its requests.

The archive answers ``GET <url>?entity_type=individual&study_id=..`` with its catalogue and ``..entity_type=event..`` with
fixes, both as CSV; the latter takes ``individual_local_identifier``, ``timestamp_start`` and ``timestamp_end``
(yyyyMMddHHmmssSSS, both inclusive) and ``attributes``. One partition is one tag of one study (or a ``slice`` of its time,
where catalogues say when a tag began and ended), read by one request, as a stream of Arrow batches. Tasks that fail
are tried again as a whole; a request that fails makes its task fail.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("track_archive").option("url", url).option("studies", "12,13").load().filter("TagID = 'a1'")

Filters on ``TagID`` (equal, in) pick partitions; those on ``DateTime`` narrow the requests and are checked again by
Spark. Nulls: values that can't be read as their column's type are null; columns the archive doesn't know are null, and
only columns asked for are requested.
"""

from __future__ import annotations

import base64
import csv
import datetime as dt
import io
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wayspan.operators.schema import ORDER, Order
from wayspan.session import ship
from wayspan.sources.tracks import ARCHIVE_NAMES, finish, time_windows

COLUMNS = "TagID string, DateTime timestamp, longitude double, latitude double, speed_2d double, direction double, altitude double, satellites_used int, gps_pdop double, gps_hdop double, study string"
BATCH = 20_000
#: The archive's names of our columns: underscored, as requests take them.
_REMOTE = {ours: theirs for theirs, ours in ARCHIVE_NAMES.items() if "_" in theirs and "." not in theirs}


def _stamp(us: int) -> str:
    t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    return t.strftime("%Y%m%d%H%M%S") + f"{t.microsecond // 1000:03d}"


def _micros(v: dt.datetime) -> int:
    v = v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    d = v - dt.datetime(1970, 1, 1)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _time(text: str) -> int | None:
    text = text.strip()
    for form in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return _micros(dt.datetime.strptime(text, form))
        except ValueError:
            pass
    return None


@dataclass
class TagPart(InputPartition):
    study: str
    tag: str
    start: int | None
    end: int | None


class ArchiveSource(DataSource):
    """Options: ``url``; ``studies``, comma-separated; ``user`` and ``password``; ``slice``, days of one request."""

    @classmethod
    def name(cls) -> str:
        return "track_archive"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = {k.lower(): v for k, v in options.items()}, schema
        self.tags: set[str] | None = None
        self.start: int | None = None
        self.end: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "TagID" and isinstance(f, (EqualTo, In)):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tags = found if self.tags is None else self.tags & found
                continue
            if column == "DateTime" and isinstance(getattr(f, "value", None), dt.datetime):
                at = _micros(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = at if self.start is None else max(self.start, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = at if self.end is None else min(self.end, at)
            yield f  # requests know milliseconds only, so Spark looks again

    def _get(self, **query) -> io.TextIOBase:
        request = urllib.request.Request(self.options["url"] + "?" + urllib.parse.urlencode(query))
        if self.options.get("user"):
            pair = f"{self.options['user']}:{self.options.get('password', '')}".encode()
            request.add_header("Authorization", "Basic " + base64.b64encode(pair).decode())
        return io.TextIOWrapper(urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 300))), "utf-8", newline="")

    def partitions(self) -> list[TagPart]:
        """A part for each wanted tag of the catalogue, in slices of time where it says from when to when the tag has data."""
        parts, width = [], int(float(self.options.get("slice", 0)) * 86_400_000_000)
        for study in filter(None, (s.strip() for s in self.options.get("studies", "").split(","))):
            with self._get(entity_type="individual", study_id=study) as text:
                for r in csv.DictReader(text):
                    tag = r.get("local_identifier", "")
                    if not tag or (self.tags is not None and tag not in self.tags):
                        continue
                    first, last = _time(r.get("timestamp_start") or ""), _time(r.get("timestamp_end") or "")
                    start, end = (max((v for v in (a, b) if v is not None), default=None) if f is max else min((v for v in (a, b) if v is not None), default=None) for f, a, b in ((max, self.start, first), (min, self.end, last)))
                    if start is not None and end is not None and start > end:
                        continue
                    if width and start is not None and end is not None:
                        cuts = list(range(start, end, width)) or [start]
                        # Requests are inclusive at both ends and know milliseconds: each begins one after the last's end.
                        parts += [TagPart(study, tag, a if i == 0 else a // 1000 * 1000 + 1000, min(a + width, end)) for i, a in enumerate(cuts)]
                    else:
                        parts.append(TagPart(study, tag, start, end))
        return parts

    def read(self, part: TagPart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no tag is wanted
            return
        names = [f.name for f in self.schema.fields]
        query = {"entity_type": "event", "study_id": part.study, "individual_local_identifier": part.tag, "attributes": ",".join(_REMOTE[n] for n in names if n in _REMOTE)}
        if part.start is not None:
            query["timestamp_start"] = _stamp(part.start)
        if part.end is not None:
            query["timestamp_end"] = _stamp(part.end)
        arrow = to_arrow_schema(self.schema)
        with self._get(**query) as text:
            rows = csv.reader(text)
            head = [ARCHIVE_NAMES.get(c, c) for c in next(rows, [])]
            at = {c: i for i, c in enumerate(head)}
            held: list[list[str]] = []
            for r in rows:
                held.append(r)
                if len(held) >= BATCH:
                    yield self._batch(held, at, part, names, arrow)
                    held = []
            if held:
                yield self._batch(held, at, part, names, arrow)

    def _batch(self, rows: list[list[str]], at: dict[str, int], part: TagPart, names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
        def value(r: list[str], n: str, kind: pa.DataType):
            if n == "TagID":
                return part.tag
            if n == "study":
                return part.study
            text = r[at[n]] if n in at and at[n] < len(r) else ""
            if text == "":
                return None
            try:
                if pa.types.is_timestamp(kind):
                    return _time(text)
                return float(text) if pa.types.is_floating(kind) else int(float(text)) if pa.types.is_integer(kind) else text
            except ValueError:
                return None

        return pa.RecordBatch.from_arrays([pa.array([value(r, f.name, f.type) for r in rows], f.type) for f in arrow], schema=arrow)


def archive_table(spark: SparkSession, url: str, studies: list[str], tags: list[str] | None = None, start: str | None = None, end: str | None = None, **options) -> DataFrame:
    """The archive's rows; tags and times (inclusive) narrow what is asked of it."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = spark.read.format("track_archive").options(url=url, studies=",".join(studies), **{k: str(v) for k, v in options.items()}).load()
    if tags:
        d = d.filter(d.TagID.isin(list(tags)))
    if start:
        d = d.filter(f"DateTime >= timestamp'{start}'")
    return d.filter(f"DateTime <= timestamp'{end}'") if end else d


def read_tracks_archive(spark: SparkSession, url: str, studies: list[str], tags: list[str] | None = None, start: str | None = None, end: str | None = None, bounds: DataFrame | None = None, order: Order = ORDER, options: dict | None = None, **how) -> DataFrame:
    """Tracks of a web archive, finished like those of any source. ``bounds`` (tag, start, end) are windows by tag."""
    d = archive_table(spark, url, studies, tags, start, end, **(options or {})).drop("study")
    return finish(time_windows(d, bounds, order) if bounds is not None else d, order=order, **how)
