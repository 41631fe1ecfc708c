"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded as the double that it is, half to even, as C's printf does; null stays null.

    ``format_string`` rounds the shortest decimals that tell the double, half up: 1.005 becomes 1.01, though the double lies
    below 1.005. Here twice the scaled fraction is set against the odd integer next to it, with the product's error,
    which is exact by splitting the fraction in two. From 2 to the 63rd on ``format_string`` stays.
    """
    v = v.cast("double")
    a, scale = F.abs(v), float(2 * 10**digits)
    part = a - F.floor(a)
    p = part * scale
    big = part * 134217729.0
    high = big - (big - part)
    below = F.floor(p / 2)
    over = (p - (2 * below + 1)) + ((high * scale - p) + (part - high) * scale)
    n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    whole = F.floor(a) + F.when(n == 10**digits, 1).otherwise(0)
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, whole.cast("string"), *([F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")] if digits else []))
    return F.when(v.isNotNull(), F.when(a < 2.0**63, text).otherwise(F.format_string(f"%.{digits}f", v)))
