"""Table kinds, their checks, and regroupings.

A stack of tables is one DataFrame: the tag column is its partition key, and a second column names the stack where
there are several. Row order is never implied; operators take an ``Order``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = {
    "track": ("TagID", "DateTime", "longitude", "latitude"),
    "trip": ("TagID", "DistMax", "TripDur"),
    "accn": ("TagID", "DateTime", "x_acceleration", "y_acceleration", "z_acceleration"),
    "pressure": ("TagID", "DateTime", "pressure_avg"),
    "voltage": ("TagID", "DateTime", "vsll", "vbat"),
    "voltage_comm": ("TagID", "DateTime", "vbat", "bytes_communicated"),
}
#: The wide layout that sources emit, fixed values.
WIDE = (
    "Type TagID DateTime speed_2d speed_3d traj_speed latitude longitude X Y dist dt satellites_used gps_fixtime gps_pdop gps_hdop altitude altitude_agl h_accuracy v_accuracy "
    "pressure temperature x_speed y_speed z_speed speed_accuracy direction location flt_switch tag_voltage battery_charging_current"
).split()


@dataclass(frozen=True)
class Order:
    """How a table's rows are keyed and ordered; ``seq`` breaks ties in time."""

    key: str = "TagID"
    time: str = "DateTime"
    seq: str | None = None

    @property
    def by(self) -> list[str]:
        return [self.time, *([self.seq] if self.seq else [])]

    def window(self, *more: str):
        return W.partitionBy(self.key, *more).orderBy(*self.by)

    def whole(self, *more: str):
        return W.partitionBy(self.key, *more)


ORDER = Order()


def micros(t: str | Column) -> Column:
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def missing(df: DataFrame, kind: str) -> list[str]:
    return [c for c in KINDS[kind] if c not in df.columns]


def is_kind(df: DataFrame, kind: str, strict: bool = True) -> bool:
    """Whether ``df`` has the columns of ``kind``; strict also asks that times be timestamps."""
    if missing(df, kind):
        return False
    return not strict or "DateTime" not in KINDS[kind] or df.schema["DateTime"].dataType.typeName().startswith("timestamp")


def is_stack(df: DataFrame, kind: str, stack_col: str = "stack", strict: bool = True) -> bool:
    """Whether ``df`` is a stack of stacks of ``kind``: its columns, and one that names the stack. (A table of several tags
    is a stack of one level as it is.)"""
    return stack_col in df.columns and is_kind(df, kind, strict)


def validate(df: DataFrame, kind: str = "track") -> DataFrame:
    """``df`` itself, or an error that names what it lacks."""
    if lacks := missing(df, kind):
        raise ValueError(f"{kind}: missing columns {', '.join(lacks)}")
    if not is_kind(df, kind):
        raise TypeError(f"{kind}: DateTime must be a timestamp")
    return df


def stack(*tables: DataFrame, names: list[str] | None = None, kind: str = "track") -> DataFrame:
    """Tables under one another; with ``names`` a column ``stack`` tells them apart."""
    parts = [validate(t, kind) for t in tables]
    if names:
        parts = [t.withColumn("stack", F.lit(n)) for t, n in zip(parts, names, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split(df: DataFrame, by: str, names: list | None = None, most: int = 10_000) -> dict:
    """The sub-tables of the given values of a column, in that order, empty ones included. Without names all values of
    the column are taken, of which the driver holds a table each; more than ``most`` of them are an error. A table of
    many groups is better left whole and keyed (see ``restack``)."""
    if names is None:
        names = [r[0] for r in df.select(by).distinct().limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"{by}: more than {most} values")
        names.sort(key=lambda v: (v is not None, v))
    return {n: df.filter(F.col(by).eqNullSafe(F.lit(n))) for n in names}


def restack(df: DataFrame, by: str, outer: str | None = None, key: str = "TagID", stack_col: str = "stack") -> DataFrame:
    """One table as a stack by a column, or as a stack of stacks by two: ``key`` takes the values of ``by``, ``stack``
    those of ``outer``. Rows without a value belong to no group and are left out."""
    d = df.filter(F.col(by).isNotNull()).withColumn(key, F.col(by))
    return d.filter(F.col(outer).isNotNull()).withColumn(stack_col, F.col(outer)) if outer else d


def flatten_stacks(df: DataFrame, key: str = "TagID", stack_col: str = "stack") -> DataFrame:
    """One level less: the tag becomes ``<tag>_stack_<stack>``, so equal tags of different stacks stay apart."""
    return df.withColumn(key, F.concat_ws("_stack_", F.col(key).cast("string"), F.col(stack_col).cast("string"))).drop(stack_col)


def simplify(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*KINDS["track"], *[c for c in keep if c not in KINDS["track"]])


def tag_ids(df: DataFrame, key: str = "TagID", stack_col: str | None = None) -> DataFrame:
    return df.select(*([stack_col] if stack_col else []), key).distinct()


def to_voltage(df: DataFrame, vsll: str | None = None, vbat: str | None = None) -> DataFrame:
    """Tag, time and two voltage columns; one that isn't named is null."""
    pick = lambda c: F.col(c).cast("double") if c and c in df.columns else F.lit(None).cast("double")
    return df.select("TagID", "DateTime", pick(vsll).alias("vsll"), pick(vbat).alias("vbat"))


def add_wide_columns(df: DataFrame) -> DataFrame:
    """The wide layout; columns that the source lacks are null doubles."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in WIDE])


@dataclass(frozen=True)
class Options:
    """How tables are shown."""

    rows: int = 10
    truncate: int = 20
    vertical: bool = False


_defaults = Options()
_current = [_defaults]


def set_options(**new) -> Options:
    _current[0] = replace(_current[0], **new)
    return _current[0]


def get_options() -> Options:
    return _current[0]


def reset_options() -> Options:
    _current[0] = _defaults
    return _defaults


def show(df: DataFrame) -> None:
    o = get_options()
    df.show(o.rows, o.truncate, o.vertical)


def stamp(df: DataFrame, step: str, key: str = "TagID", **parameters) -> DataFrame:
    """``df`` that remembers a step and its parameters in the schema, beside what it remembers already: on the tag's column,
    so that it survives writing to formats that keep Spark's schema, and every operator that keeps the column."""
    known = attributes(df, key)
    known[step] = json.loads(json.dumps(parameters, default=str))
    return df.withMetadata(key, {**df.schema[key].metadata, "attributes": json.dumps(known)})


def attributes(df: DataFrame, key: str = "TagID") -> dict[str, dict]:
    """Steps and parameters that ``df`` remembers, in the order they came."""
    return json.loads(df.schema[key].metadata.get("attributes", "{}"))


def give_attributes(df: DataFrame, given: dict[str, dict], key: str = "TagID") -> DataFrame:
    """``df`` with attributes got from another table, for operators that make new rows from scratch."""
    for step, parameters in given.items():
        df = stamp(df, step, key, **parameters)
    return df


@dataclass
class Tracked:
    """A DataFrame with the parameters that made it."""

    data: DataFrame
    attributes: dict = field(default_factory=dict)

    def give(self, df: DataFrame, **more) -> Tracked:
        return Tracked(df, {**self.attributes, **more})
