"""Tracks as streams, put in order: gap sections and the speed filter with the very rows that they have in batches.

Fixes that come late, but within the watermark, wait in a tag's state until the watermark has passed them. A section is
worked out once it is closed: by a fix after more than the gap, or by the watermark having passed that time. Its last fix
waits for the next one, since ``dt`` reaches to it; a timer at ``expire`` after the last fix gives it out without one and
drops the tag's state. So the state of a tag is its open section, and none at all once the tag has fallen silent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wayspan.operators.movement import section_flags
from wayspan.session import ship

_FIX = "us bigint, lon double, lat double, seq bigint"
_OUT = ["us", "longitude", "latitude", "seq", "dt", "gap", "gapsec", "speed_rm"]


class _Ordered(StatefulProcessor):
    """``fixes``: those not yet given out, but for the last of a closed section, which is in ``held``."""

    def __init__(self, key: str, gap: float, tol: float, limit: float | None, expire: float):
        self.key, self.most, self.limit, self.expire = key, int(gap * (1 + tol) * 1e6), limit, int(expire * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixes = handle.getListState("fixes", _FIX)
        self.held = handle.getValueState("held", _FIX + ", section bigint, flag int, first boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [f for b in rows for f in zip(b["us"].tolist(), b["longitude"].astype(float).tolist(), b["latitude"].astype(float).tolist(), b["seq"].tolist())]
        if new:
            self.fixes.appendList(new)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """Give out what fixes before the watermark decide, and set the next timer."""
        fixes = sorted(self.fixes.get() if self.fixes.exists() else [], key=lambda f: (f[0], f[3]))
        held = self.held.get() if self.held.exists() else None
        known = sum(f[0] < mark for f in fixes)
        out, begin = [], 0
        for i in range(known):
            follows = fixes[i + 1] if i + 1 < known else None
            ends = follows[0] - fixes[i][0] > self.most if follows else mark > fixes[i][0] + self.most
            if not ends:
                continue
            part = fixes[begin : i + 1]
            section, first = (held[4] + 1, False) if held else (1, True)
            if held:
                out.append(self._row(held, part[0][0]))
            flags = section_flags(*(np.array([f[c] for f in part], float) for c in range(3)), self.limit) if self.limit is not None else [0] * len(part)
            rows = [(*f, section, int(k), first and not j) for j, (f, k) in enumerate(zip(part, flags))]
            out += [self._row(r, after[0]) for r, after in zip(rows, rows[1:])]
            held, begin = rows[-1], i + 1
        rest = fixes[begin:]
        if held and not rest and mark > held[0] + self.expire:
            out.append(self._row(held, None))
            held = None
        self.fixes.put(rest) if rest else self.fixes.clear()
        self.held.update(held) if held else self.held.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waits = [f[0] for f in rest[:1]] if known < len(fixes) else []
        last = rest[-1][0] + self.most if rest else held[0] + self.expire if held else None
        if last is not None:
            # Past the next fix that still waits for the watermark, or past the time that closes the section or the tag.
            self.handle.registerTimer(max(mark, min([fixes[known][0], last] if waits else [last])) // 1000 + 1)
        if out:
            d = pd.DataFrame(out, columns=_OUT)
            d.insert(0, self.key, key[0])
            yield d

    def _row(self, r, following: int | None):
        us, lon, lat, seq, section, flag, first = r
        dt = None if following is None else (following - us) / 1e6
        gap = 0 if first and following is not None else int(following is None or following - us > self.most)
        none = lambda x: None if x is None or math.isnan(x) else x
        return us, none(lon), none(lat), seq, dt, gap, section, flag

    def close(self) -> None:
        pass


def ordered_tracks(df: DataFrame, gap: float = 28800, tol: float = 0.2, limit: float | None = 50, late: str = "1 day", expire: float = 30 * 86400, key: str = "TagID", time: str = "DateTime", seq: str | None = None) -> DataFrame:
    """A stream of fixes with dt, gap, gapsec and speed_rm (0 without a ``limit``), as ``gap_section`` and ``speed_filt``
    (on sections) give them for the whole table.

    ``late`` is how far fixes may come out of order; later ones are dropped by the watermark. ``expire`` seconds (more than
    the gap) after a tag's last fix its state goes; should it move again, sections count from 1. Rows without a time can't
    be put in order and are left out; ones without a place are kept and never flagged. Needs the RocksDB state store.
    """
    if expire <= gap * (1 + tol):
        raise ValueError("expire must be longer than the gap")
    ship(df.sparkSession)
    d = df.withColumn("__time", F.col(time).cast("timestamp")).filter(F.col("__time").isNotNull() & F.col(key).isNotNull()).withWatermark("__time", late)
    d = d.select(key, "__time", F.unix_micros("__time").alias("us"), "longitude", "latitude", (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias("seq"))
    kind = df.schema[key].dataType.simpleString()
    out = d.groupBy(key).transformWithStateInPandas(
        _Ordered(key, gap, tol, limit, expire), f"{key} {kind}, us bigint, longitude double, latitude double, seq bigint, dt double, gap int, gapsec bigint, speed_rm int", "append", "EventTime"
    )
    return out.select(key, F.timestamp_micros("us").alias(time), *([F.col("seq").alias(seq)] if seq else []), "longitude", "latitude", "dt", "gap", "gapsec", "speed_rm")
