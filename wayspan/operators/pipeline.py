"""The cleaning pipeline: all checks in order, annotating or dropping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspan.operators import checks, duplicates, enrich, movement
from wayspan.operators.schema import ORDER, Order, Tracked, stamp, validate

C = F.col


@dataclass
class Cleaning:
    """What to check. With annotate later stages see flagged rows; without they see what is left."""

    na_position: bool = True
    all_na: bool = True
    dup_method: str | None = "first"
    dup_methods: dict[str, str] = field(default_factory=dict)
    use_dup_coords: bool = False
    quality_vars: Sequence[str] = ()
    quality_directions: Sequence[int] = ()
    min_fix: int = 0
    min_fix_when: str = "after_NA"
    spans: dict = field(default_factory=dict)
    sat_check: bool = True
    drop_sats: int = 3
    sat_col: str = "satellites_used"
    flt_switch: bool = False
    pdop: float | None = None
    hdop: float | None = None
    custom: tuple[Sequence, Sequence, Sequence] | None = None
    gap: float = 28800
    tol: float = 0.2
    drop_single_gap: bool = False
    speed: float | None = None
    speed_method: str = "none"
    hybrid: bool = False
    turn: float | None = None
    turn_direction: str = "less_than"
    project: bool = True


def clean_track(df: DataFrame, how: Cleaning | None = None, annotate: bool = True, order: Order = ORDER) -> Tracked:
    """The cleaned table with its parameters and the flags in stage order (``attributes['flags']``); the table's schema remembers
    them too (``schema.attributes``)."""
    p = how or Cleaning()
    # One exchange by tag: windows by tag and time, tag and place, or whole rows find their rows together already.
    d, flags = validate(df).repartition(order.key), []

    def stage(d: DataFrame, *names: str) -> DataFrame:
        flags.extend(names)
        if annotate:
            return d
        for n in names:
            d = checks.drop_flagged(d, n)
        return d

    if p.na_position:
        d = stage(checks.null_position(d), "NA_latlong_rm")
    if p.all_na:
        d = stage(checks.all_null(d, df.columns), "all_NA_rm")
    if p.dup_method:
        if annotate:
            d = duplicates.duplicate_track(d, use_coords=p.use_dup_coords, mode="annotate", order=order)
            flags += [f for f in ("dup_parallel_rm", "dup_time_rm", "dup_coords_rm", "dup_time_coords_rm", "all_dup_rm") if f in d.columns]
        else:
            d = duplicates.duplicate_track(d, p.dup_method, p.quality_vars, p.quality_directions, p.use_dup_coords, "resolve", p.dup_methods, order=order)
    if p.min_fix and p.min_fix_when == "after_NA":
        d = stage(checks.few_fixes(d, p.min_fix, order=order), "tid_rm")
    if p.spans:
        before = set(d.columns)
        d = checks.tag_spans(d, mode="annotate", order=order, **p.spans)
        new = [c for c in d.columns if c not in before]
        d = d.withColumnsRenamed({c: c.replace("_issue", "_rm") for c in new})
        d = stage(d, *[c.replace("_issue", "_rm") for c in new])
    if p.sat_check and p.sat_col in d.columns:
        d = stage(checks.satellites(d, p.drop_sats, p.sat_col), "sat_rm")
    if p.flt_switch:
        d = stage(checks.flight_switch(d), "flt_rm")
    for column, limit in (("gps_pdop", p.pdop), ("gps_hdop", p.hdop)):
        if limit is not None and column in d.columns:
            d = stage(checks.precision(d, column, limit), f"{column}_rm")
    if p.custom:
        rules = [r for r in zip(*p.custom, strict=True) if f"{r[0]}_rm" not in flags]
        if rules:
            names, lower, upper = zip(*rules)
            d = checks.filt_err(d, names, lower, upper, all_flag=False)
            d = stage(d, *[f"{n}_rm" for n in names])
    d = movement.gap_section(d, p.gap, p.tol, order=order)
    if p.drop_single_gap:
        d = stage(checks.single_sections(d, order=order), "singlegap_rm")
    front = d.columns
    if p.speed is not None:
        d = stage(movement.speed_filt(d, p.speed, p.speed_method, p.hybrid, order=order), "speed_rm")
    if p.turn is not None:
        d = stage(movement.turn_filt(d, p.turn, p.turn_direction, order=order), "angle_rm")
    if p.project:  # late, so that no sort holds the coordinates
        d = enrich.project(d)
        d = d.select(*dict.fromkeys([*front, "X", "Y", *d.columns]))
    if p.min_fix and p.min_fix_when == "after_all":
        d = stage(checks.few_fixes(d, p.min_fix, order=order), "tid_rm")
    if annotate:
        d = checks.combined(d, flags)
    d = movement.time_steps(d, order)
    told = {f.name: getattr(p, f.name) for f in fields(p)}
    return Tracked(stamp(d, "clean_track", order.key, flags=flags, annotate=annotate, **told), {"cleaning": p, "flags": flags, "annotate": annotate})
