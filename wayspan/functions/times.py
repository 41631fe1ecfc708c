"""Parsing of times written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order; each row is parsed by the first that fits.
FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm:ss", "dd/MM/yy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yy-MM-dd HH:mm:ss", "yy-MM-dd HH:mm")
_SHAPES = {
    "dd/MM/yyyy HH:mm:ss": r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$",
    "dd/MM/yyyy HH:mm": r"^\d\d/\d\d/\d{4} \d\d:\d\d$",
    "dd/MM/yy HH:mm:ss": r"^\d\d/\d\d/\d\d \d\d:\d\d:\d\d$",
    "dd/MM/yy HH:mm": r"^\d\d/\d\d/\d\d \d\d:\d\d$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d\d-\d\d \d\d:\d\d$",
    "yy-MM-dd HH:mm:ss": r"^\d\d-\d\d-\d\d \d\d:\d\d:\d\d$",
    "yy-MM-dd HH:mm": r"^\d\d-\d\d-\d\d \d\d:\d\d$",
}


def datetime(text: Column, auto: bool = True, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """A timestamp in the session's zone; null where no format fits. ``auto=False`` tries ``fmt`` alone."""
    t = F.trim(text)
    if not auto:
        return F.try_to_timestamp(t, F.lit(fmt))
    return F.coalesce(*[F.when(F.regexp_like(t, F.lit(_SHAPES[f])), F.try_to_timestamp(t, F.lit(f))) for f in FORMATS])
