"""Near-duplicates by HyperMinHash.

A document's set is its distinct word shingles. Each of REGISTERS buckets keeps the least value of the set under the
bucket's own hash, stored as a 6-bit count of leading zeros and 10 mantissa bits. (Every shingle enters every bucket,
so that short documents leave none empty.) Documents with equal sets are one class. Bands of registers bring classes
together; a candidate pair's Jaccard index is estimated from equal registers, corrected for the chance that unequal
minima compress alike, and pairs that could reach the threshold are confirmed on their full sets.

In a band's bucket all members are first measured against one hub, the member that meets most others. Members whose
components then still differ are paired only where what they have beyond the hub, or their sizes, leave a link
possible (see ``_crossing``). So a group of copies costs a few rows per copy and yet no link between components is lost.

Nulls and empty texts have empty sets, which link with nothing. Texts with fewer words than a shingle are one shingle.
Rows with equal ids count as one document; a row with a null id is kept and belongs to no component. Ids are of any
type with an order; texts are read whole. Only key and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch
from wayspan.llm.components import components
from wayspan.session import ship

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Ids of candidate documents up to which they are broadcast.
BROADCAST_IDS = 1_000_000
#: Pairs of one hub beyond which they are dealt out in parts.
HOT = 500
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """Word to 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(w)
        if len(self) < 500_000:
            self[w] = h
        return h


_words = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(33))) * _C2
    return h ^ (h >> np.uint64(33))


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if isinstance(text, str) else []


def shingle_set(ws: list[bytes], n: int) -> set[bytes]:
    if not ws:
        return set()
    return {b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def shingle_hashes(ws: list[bytes], n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out ^ h[i : len(h) - n + 1 + i]) + np.uint64(i)
    return np.unique(out)


def _salts() -> tuple[np.ndarray, np.ndarray]:
    i = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    return i[:REGISTERS], i[REGISTERS:] | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a set: leading zeros above mantissa bits."""
    xor, odd = _salts()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] ^ xor
        part *= odd
        np.minimum(least, part.min(0), out=least)
    top = np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.float64) * (1 - 2**-53))).astype(np.int64)
    top = np.clip(top, MANTISSA, 63)
    mantissa = (least >> (top - MANTISSA).astype(np.uint64)) & np.uint64(2**MANTISSA - 1)
    return (((63 - top).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard index from registers: the share of equal ones, less the expected share of chance collisions.

    Two unrelated minima share a mantissa given equal leading zeros with chance 2^-MANTISSA; for sets of like size a
    third to a half of the leading-zero counts agree.
    """
    same = (a == b).mean(1)
    r = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = 2.0**-MANTISSA * 2 * r / (1 + r) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1)


def signatures(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Per row: set size, two sums of hashes that identify the set, and its registers."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                h = shingle_hashes(word_list(t), n)
                s1, s2 = int(h.sum(dtype=np.uint64)), int(mix(h ^ _C1).sum(dtype=np.uint64))
                out.append((len(h), np.uint64(s1).astype(np.int64), np.uint64(s2).astype(np.int64), registers(h).tobytes() if len(h) else None))
            yield pd.DataFrame(out, columns=["n_shingles", "s1", "s2", "regs"]).assign(key=b["key"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInPandas(sign, f"key {kind}, n_shingles long, s1 long, s2 long, regs binary")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate leaves the threshold within four standard errors."""
    t = percent / 100
    least = t - 4 * (t * (1 - t) / REGISTERS) ** 0.5

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ra, rb = (np.frombuffer(b"".join(b[c]), "<u2").reshape(len(b), REGISTERS) for c in ("ra", "rb"))
                na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
                size = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                yield b.loc[size & (estimate(ra, rb, na, nb) >= least), ["a", "b"]]

    kind = reps.schema["rep"].dataType.simpleString()
    side = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.col("regs").alias("r"))
    return _both_sides(pairs, side).mapInPandas(likely, f"a {kind}, b {kind}")


def _both_sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Written pairs (a, b) with what ``side`` (id and others) has for both. The pairs of a b that occurs more than HOT
    times are dealt out in parts of about HOT rows, each with its own copy of b's row."""
    named = lambda x: side.select(*[F.col(c).alias(x if c == "id" else c + x) for c in side.columns])
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("b", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    hot = F.broadcast(hot) if hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else hot
    parts = F.coalesce("parts", F.lit(1))
    p = pairs.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    s = named("b").join(hot, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return p.join(named("a"), "a").join(s, ["b", "part"]).drop("part")


def _reaches(both: int, x: int, y: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (x + y - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for ta, tb in zip(b["ta"], b["tb"]):
                x, y = shingle_set(word_list(ta), n), shingle_set(word_list(tb), n)
                ok.append(_reaches(len(x & y), len(x), len(y), percent))
            yield b.loc[ok, ["a", "b"]]

    kind = pairs.schema["a"].dataType.simpleString()
    return _both_sides(pairs, texts).mapInPandas(exact, f"a {kind}, b {kind}")


def _measured(star: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, na, nb, both, linked, extra) of each member a and hub b on full sets; extra: hashes of what b lacks."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, y, hy = None, set(), np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for i, k, ta, tb in zip(b["a"], b["b"], b["ta"], b["tb"]):
                if k != hub:
                    ws = word_list(tb)
                    hub, y, hy = k, shingle_set(ws, n), shingle_hashes(ws, n)
                ws = word_list(ta)
                x = shingle_set(ws, n)
                both = len(x & y)
                extra = np.setdiff1d(shingle_hashes(ws, n), hy, assume_unique=True).view(np.int64)
                out.append((i, k, len(x), len(y), both, _reaches(both, len(x), len(y), percent), extra))
            yield pd.DataFrame(out, columns=["a", "b", "na", "nb", "both", "linked", "extra"])

    kind = star.schema["a"].dataType.simpleString()
    return _both_sides(star, texts).mapInPandas(measure, f"a {kind}, b {kind}, na int, nb int, both int, linked boolean, extra array<bigint>")


def _crossing(star: DataFrame, met: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of members of one hub that could link although their components differ.

    Two members have at most the lesser of their overlaps with the hub in common, and the shingles outside the hub that
    both have. So a pair either shares such shingles, is found by them and kept if their number leaves a link
    possible, or shares none and is found by class of size where sizes alone allow it. Others can't reach the threshold.
    """
    label = met.select(F.col("node").alias("a"), F.col("component").alias("c"))
    s = star.join(label, "a", "left").withColumn("c", F.coalesce("c", "a"))
    hub = met.select(F.col("node").alias("b"), F.col("component").alias("ch"))
    s = s.join(hub, "b", "left").withColumn("ch", F.coalesce("ch", "b"))
    split = s.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("b")
    most = F.floor(F.col("both") * (100 + percent) / percent) - F.col("na")  # largest partner that the overlap allows
    s = scratch.write(s.join(split, "b").withColumn("most", most), "open")
    ends = lambda d, x: d.select("b", "k", F.col("a").alias(x), F.col("c").alias(f"c{x}"), F.col("na").alias(f"n{x}"), F.col("both").alias(f"o{x}"), F.col("most").alias(f"m{x}"))
    sized = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (F.col("cx") != F.col("cy"))
    by_token = s.select("*", F.explode("extra").alias("k"))
    mixed = by_token.groupBy("b", "k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("b", "k")
    by_token = by_token.join(mixed, ["b", "k"])
    sharing = ends(by_token, "x").join(ends(by_token, "y"), ["b", "k"]).filter(sized & (F.col("x") < F.col("y")))
    sharing = sharing.groupBy("b", "x", "y", "nx", "ny", "ox", "oy").agg(F.count("*").alias("s"))
    sharing = sharing.filter((100 + percent) * (F.least("ox", "oy") + F.col("s")) >= percent * (F.col("nx") + F.col("ny")))
    grain = F.greatest(F.floor(F.col("nb") / 32), F.lit(1))
    cls = F.floor(F.col("na") / grain)
    low, high = F.ceil(F.col("na") * percent / 100), F.least(F.col("most"), F.floor(F.col("na") * 100 / percent))
    # One of the two isn't of the hub's component; it looks for partners of every size that it allows.
    lone = s.filter(F.col("c") != F.col("ch")).filter(low <= high)
    lone = lone.withColumn("k", F.explode(F.sequence(F.floor(low / grain), F.floor(high / grain))))
    allowed = ends(lone, "x").join(ends(s.withColumn("k", cls), "y"), ["b", "k"]).filter(sized & (F.col("ny") <= F.col("mx")) & (F.col("nx") <= F.col("my")))
    pair = lambda d: d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pair(sharing).union(pair(allowed)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (least key reachable over links) and kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    signed = scratch.write(signatures(docs, key, text, n), "signed")
    sets = ["n_shingles", "s1", "s2"]
    reps = scratch.write(signed.filter("n_shingles > 0 and key is not null").groupBy(*sets).agg(F.min("key").alias("rep"), F.any_value("regs").alias("regs")), "reps")
    bands = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {2 * ROWS * i + 1}, {2 * ROWS})")) for i in range(BANDS)])
    band = reps.select("rep", F.explode(bands).alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    member = scratch.write(band.join(shared, "band"), "members")
    degree = member.groupBy("rep").agg(F.sum(F.col("m") - 1).alias("degree"))
    ranked = member.join(degree, "rep")
    hub = ranked.groupBy("band").agg(F.min_by("rep", F.struct(-F.col("degree"), F.col("rep"))).alias("hub"))
    star = member.join(hub, "band").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = scratch.write(member.select(F.col("rep").alias("id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:  # else the texts are dealt out by id
        wanted = F.broadcast(wanted)
    texts = scratch.write(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(wanted, "id", "left_semi"), "texts")
    star = scratch.write(_measured(scratch.write(star, "hubs"), texts, n, percent), "star")
    first = star.filter("linked").select("a", "b")
    met = components(first, Scratch(spark, "met"))
    crossing = scratch.write(_crossing(star, met, percent, scratch), "crossing")
    more = scratch.write(_plausible(crossing, reps, percent), "more")
    second = scratch.write(_confirmed(more, texts, n, percent), "second")
    # The second links join whole components: those are the nodes now.
    of = lambda x: met.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = second.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between, Scratch(spark, "merged")).select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = reps.join(met, reps.rep == met.node, "left").select(*sets, F.coalesce("component", "rep").alias("component"))
    classes = known.join(merged, "component", "left").select(*sets, F.coalesce("top", "component").alias("component_id"))
    out = signed.select("key", *sets).join(classes, sets, "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), component).alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the least id (and of equal ids, by text).

    ``key`` is a long. Rows of one id with different texts are documents of their own: should there be any, ids are
    extended by a hash of the text. Rows equal in id and text are one document and stay or go together; rows with a null
    id, a null or an empty text stay. Columns are unchanged.
    """
    d = docs.select(F.col(key).alias("__k"), F.xxhash64(text).alias("__t"))
    twice = d.filter("__k is not null").groupBy("__k").agg((F.min("__t") < F.max("__t")).alias("mixed")).filter("mixed").limit(1).count()
    name = F.col(key)
    if twice:
        name = name.cast("decimal(38,0)") * F.lit(2**60).cast("decimal(19,0)") + F.pmod(F.xxhash64(text), F.lit(2**60)).cast("decimal(19,0)")
    named = docs.withColumn("__name", name.cast("decimal(38,0)") if twice else name)
    gone = near_duplicates(named.select("__name", F.col(text).alias("__text")), "__name", "__text", n, percent).filter("not kept").select("__name").distinct()
    return named.join(gone, "__name", "left_anti").select(docs.columns)
