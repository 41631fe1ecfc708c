"""Document fingerprints by winnowing over rolling word k-grams.

Every run of ``k`` words is hashed; of every ``window`` consecutive hashes the least is kept, the rightmost of equal
ones, with its position. Any run of ``window + k - 1`` words that two texts share therefore leaves a common hash in
both. A text of fewer than ``k`` words is one gram; one of fewer than ``window`` grams is one window.

Nulls: a null text counts as empty and has the empty fingerprint. The likeness of two fingerprints is the Dice
coefficient of their distinct hashes; two empty ones are alike (1.0), an empty and another one are not (0.0).
Nothing is capped: texts of up to 2^31 words keep every position. Keys are integers. Columns other than key and text
are not carried over by ``fingerprint_edits``; ``winnow`` carries them, and one named like its result is replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.llm.common import bounded, shuffle_partitions, words

K, WINDOW = 4, 8
_LOW = 2**31 - 1
#: Prime modulus and base of the rolling hash, fixed values: residues and their products stay within a long.
_PRIME, _BASE = 2**31 - 1, 1_000_003


def _indexes(n: Column) -> Column:
    """0 .. n - 1, none where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _doubled(d: DataFrame, col: str, width: int, join) -> DataFrame:
    """``d`` with array ``col`` of single values turned into one of runs of ``width`` values.

    A run of 2n is joined from two runs of n, so each element costs log(width) steps and not width. Runs of a width
    that is no power of two are joined from the widest power and runs kept on the way. Each step is a select of its
    own, since it reads the array before it several times.
    """
    keep = [c for c in d.columns if c != col]

    def runs(first: str, second: str, width: int, n: int) -> Column:
        """Runs of ``width`` values of ``first``, each followed by one of ``n`` values of ``second``."""
        return F.transform(_indexes(F.size(second) - width), lambda i: join(F.get(first, i), F.get(second, i + width), n))

    have, at = 0, 1  # width of the finished part, and of the powers
    left = width
    while True:
        if left % 2:
            if not have:
                d, have = d.withColumn("__acc", F.col(col)), at
            else:
                d = d.select(*keep, col, runs(col, "__acc", at, have).alias("__acc"))
                have += at
        left //= 2
        if not left:
            return d.select(*keep, F.col("__acc").alias(col))
        d = d.select(*keep, *(["__acc"] if have else []), runs(col, col, at, at).alias(col))
        at *= 2


def _grams(d: DataFrame, col: str, k: int) -> DataFrame:
    """Array ``col`` of words turned into one of grams, a long each: 31 bits of rolling hash above 31 bits of reversed
    position, so that least is smallest and rightmost. The hash of a gram is the polynomial of its words' hashes."""
    others = [c for c in d.columns if c != col]
    d = d.select(*others, F.transform(col, lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME))).alias(col))
    d = d.withColumn("__short", F.when((F.size(col) > 0) & (F.size(col) < k), F.aggregate(col, F.lit(0).cast("long"), lambda a, x: (a * _BASE + x) % _PRIME)))
    d = _doubled(d, col, k, lambda a, b, n: (a * pow(_BASE, n, _PRIME) % _PRIME + b) % _PRIME)
    d = d.select(*others, F.when(F.col("__short").isNotNull(), F.array("__short")).otherwise(F.col(col)).alias(col))
    return d.select(*others, F.transform(col, lambda h, i: F.shiftleft(h, 31).bitwiseOR(F.lit(_LOW) - i.cast("long") - 1)).alias(col))


def _minima(d: DataFrame, col: str, window: int) -> DataFrame:
    """Array ``col`` of grams turned into its window minima, each once; fewer grams than a window are one window."""
    others = [c for c in d.columns if c != col]
    d = d.withColumn("__short", F.when((F.size(col) > 0) & (F.size(col) < window), F.array(F.array_min(col))))
    powers = 1 << (window.bit_length() - 1)
    d = _doubled(d, col, powers, lambda a, b, n: F.least(a, b))
    rest = window - powers  # two overlapping runs cover the window
    d = d.select(*others, F.coalesce("__short", F.transform(_indexes(F.size(col) - rest), lambda i: F.least(F.get(col, i), F.get(col, i + rest))) if rest else F.col(col)).alias(col))
    return d.withColumn(col, F.array_distinct(col))


def winnow(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """``df`` with the kept grams of ``text`` in ``out``, as packed longs in order of position."""
    others = [c for c in df.columns if c != out]
    d = df.select(*others, words(F.col(text)).alias(out))
    return _minima(_grams(d, out, k), out, window)


def positions(kept: Column) -> Column:
    """Kept grams as (hash, pos), pos counted in words from 0."""
    return F.transform(kept, lambda v: F.struct(F.shiftrightunsigned(v, 31).alias("hash"), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW)) - 1).alias("pos")))


def hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftrightunsigned(v, 31)))


def digest(kept: Column) -> Column:
    """The hashes in order of position as one string of eight hex digits each."""
    return F.array_join(F.transform(kept, lambda v: F.lpad(F.lower(F.hex(F.shiftrightunsigned(v, 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct hashes."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _longs(values: list[int | None]) -> Column:
    """A literal array; written as text, since the plan then holds one literal instead of one for each value."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def in_order(docs: DataFrame, key: str, text: str, per: int = 4) -> DataFrame:
    """``key`` and ``text`` in buckets of ascending key, about equal in rows; each bucket also has the first rows of
    the next one (``__tail`` true), and the last has those of the first, so that every row's successor is beside it.

    Bucket bounds are approximate quantiles of all keys; their number follows the session's shuffle partitions. Null
    keys come first; rows that tie in the key are ordered by text.
    """
    spark = docs.sparkSession
    n = per * shuffle_partitions(spark)
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    cuts = d.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("q")).head()["q"] or []
    cuts = sorted(set(cuts))
    at_most = F.size(F.filter(_longs(cuts), lambda c: c <= F.col(key)))
    d = d.withColumn("__b", F.when(F.col(key).isNull(), 0).otherwise(at_most))
    firsts = bounded(d.groupBy("__b").agg(F.min(key).alias("lo"), F.max(F.col(key).isNull()).alias("nul")).orderBy("__b"), n + 1, "buckets")
    # By bucket: its first key, and the bucket before it, which gets copies of the rows of that key.
    lo, prev = [None] * (n + 1), [None] * (n + 1)
    for i, r in enumerate(firsts):
        lo[r["__b"]], prev[r["__b"]] = None if r["nul"] else r["lo"], firsts[i - 1]["__b"]
    to = F.when(F.col(key).eqNullSafe(F.element_at(_longs(lo), F.col("__b") + 1)), F.element_at(_longs(prev), F.col("__b") + 1).cast("int"))
    d = d.withColumn("__to", to)
    none = F.lit(None).cast("int")
    copies = F.filter(F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("tail")), F.struct(F.coalesce("__to", none).alias("b"), F.lit(True).alias("tail"))), lambda x: x["b"].isNotNull())
    return d.select(key, text, F.explode(copies).alias("x")).select(key, text, F.col("x.b").alias("__b"), F.col("x.tail").alias("__tail"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, likenesses to that and to the next document, and the
    kept grams' positions (in words, from 0), in the fingerprint's order.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document
    by ascending key; the first follows the last. One shuffle of the texts.
    """
    order = W.partitionBy("__b").orderBy("__tail", F.col(key).asc_nulls_first(), text)
    d = in_order(docs, key, text).withColumn("__n", F.length(text).cast("long"))
    half = F.floor(F.col("__n") / 2).cast("int")
    # A copied row's own edit is never used; its text is left out so that it isn't fingerprinted.
    edited = F.when(F.col("__tail"), F.lit("")).otherwise(F.concat(F.expr(f"left(`{text}`, int(__n - floor(__n / 2)))"), F.substring(F.lead(text).over(order), F.lit(1), half)))
    d = d.select("*", edited.alias("__e"), F.row_number().over(order).alias("__row"))
    d = d.select("*", F.sha2(F.col("__e"), 256).alias("edited_sha256"))
    d = winnow(winnow(d, text, "__k", k, window).drop(text), "__e", "__ek", k, window).drop("__e")
    d = d.select("*", hashes(F.col("__k")).alias("__h"), hashes(F.col("__ek")).alias("__eh"))
    d = d.withColumn("__nh", F.lead("__h").over(W.partitionBy("__b").orderBy("__row"))).filter("not __tail")
    return d.select(
        key,
        F.col("__n").alias("n_chars"),
        "edited_sha256",
        digest(F.col("__k")).alias("fingerprint"),
        digest(F.col("__ek")).alias("edited_fingerprint"),
        likeness(F.col("__h"), F.col("__eh")).alias("near_edited"),
        likeness(F.col("__h"), F.col("__nh")).alias("near_next"),
        F.size("__k").alias("n_kept"),
        F.transform(positions(F.col("__k")), lambda p: p["pos"]).alias("positions"),
    )
