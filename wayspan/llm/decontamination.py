"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens in a span and ignore the others, so a seed still matches where a substitution falls
on an ignored position. Seeds of the benchmark's items are joined with those of every position of every document; a
hit is confirmed on its diagonal: somewhere along it a stretch of at least a span must have ``percent`` of its tokens
equal, so an excerpt from the middle of an item counts however long the item and the document are. Tokens are
lower-cased and free of punctuation, so case and marks don't hide a passage.

No stretch of a span with at most two unequal tokens goes unseen, wherever they are. Of what the rule accepts beyond that
(15 tokens with three unequal ones, say) nearly all holds such a span or keeps another seed; figures are in the README.

Items shorter than the span are sought whole, token by token. Nulls and empty texts have no tokens: such documents are clean and such
items are never found. Repeated items and rows change nothing. A document is known by its id and its text, nulls
included. Very long texts are searched whole. Of columns with the names of results (contaminated, n_items, items) the
report takes none over, and ``decontaminate`` keeps all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch

SPAN = 12
#: Positions that a mask keeps. Deal a span's positions to four groups in turn (every fourth is one group): two unequal
#: tokens touch two groups at most, so the six positions of the other two agree. Of the six pairs of groups those
#: equally far apart are one mask, set off by a place or two, which leaves three masks to try at every position.
MASKS = tuple(tuple(sorted(p for g in (0, apart) for p in range(g, SPAN, 4))) for apart in (1, 2, 3))
PERCENT = 80
#: Seeds of the benchmark that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
SALTS = 16
#: Ids of documents with a hit that may be broadcast.
BROADCAST_DOCS = 1_000_000
#: Neighbouring diagonals that one row holds at most.
CELL = 1024
_MARKS = ".,;:!?\"'`()[]{}<>#$%&*|_~^=+/\\"
_BLANKS = "\t\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANKS + _MARKS, " " * len(_BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """A row for each mask at each place of token array ``w`` where it fits: (h, at, len). Masks beyond MASKS stand for
    whole items of ``len`` tokens; len is 0 for the others.

    The array itself isn't carried on: generated rows are held until their document is done, and each would bear a copy.
    """
    d = df.withColumn("at", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))))
    one = lambda i, m: F.when(F.col("at") + m[-1] < F.size("w"), F.xxhash64(F.lit(i), *[F.get("w", F.col("at") + p) for p in m]))
    n = F.array(*[F.struct(one(i, m).alias("h"), F.lit(len(m) if i >= len(MASKS) else 0).alias("len")) for i, m in enumerate(masks)])
    d = d.withColumn("seed", F.explode(n)).filter("seed.h is not null")
    return d.select(*keep, "at", F.col("seed.h").alias("h"), F.col("seed.len").alias("len"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", percent: int = PERCENT) -> DataFrame:
    """(key, text hash, item ids) of each document with a confirmed passage; items sorted and distinct.

    Only documents with a hit are read again and dealt out, with rows per document, item and CELL diagonals, so a text
    that repeats a passage is no unbounded group. Beyond BROADCAST_SEEDS the seeds are joined by shuffle, those of one
    hash in SALTS parts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "seeds")
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(text)).alias("iw")).filter(F.size("iw") > 0).groupBy("item", "iw").agg(F.count("*").alias("n")).drop("n")
    items = scratch.write(items.select("item", "iw", F.xxhash64("item", "iw").alias("ih")), "items")
    # Lengths below the span that occur among the items: at most SPAN - 1 numbers.
    short = sorted(r["n"] for r in items.select(F.size("iw").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    total = items.agg(F.sum(F.size("iw"))).head()[0] or 0
    masks = [*MASKS, *[tuple(range(n)) for n in short]]
    known = _seeds(items.select("ih", F.col("iw").alias("w"), F.size("iw").alias("size")), masks, ["ih", "size"])
    # A contiguous short mask stands for whole items of its length only.
    known = known.filter((F.col("len") == 0) | (F.col("len") == F.col("size"))).select("h", "ih", F.col("at").alias("in_item")).distinct()
    d = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), tokens(F.col(text)).alias("w"))
    seeds = _seeds(d, masks, ["key", "th"])
    if total * len(masks) <= BROADCAST_SEEDS:
        hits = seeds.join(F.broadcast(known), "h")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = seeds.withColumn("salt", F.pmod(F.xxhash64("key", "th", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    hits = hits.select("key", "th", "ih", (F.col("at") - F.col("in_item")).alias("shift")).distinct()
    hits = hits.groupBy("key", "th", "ih", F.floor(F.col("shift") / CELL).alias("cell")).agg(F.collect_list("shift").alias("shifts"))
    hits = scratch.write(hits.select(F.col("key").alias("k"), F.col("th").alias("t"), "ih", "shifts"), "hits")
    met = hits.select("k", "t").distinct()
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))
    if met.count() <= BROADCAST_DOCS:  # else all documents are dealt out once, by id and text
        d = d.join(F.broadcast(met), same, "left_semi")
    d = d.dropDuplicates(["key", "th"])  # rows that repeat are one document

    def confirmed(f: Column, shift: Column) -> Column:
        """Whether the diagonal's best stretch of at least ``least`` tokens has ``percent`` equal, in one pass.

        An equal token is worth 100 - percent, another -percent. The best stretch that ends at a token is the best one
        before it and that token, or the last ``least`` tokens alone.
        """
        lo = F.greatest(-shift, F.lit(0))
        hi = F.least(F.size(f["iw"]), F.size("w") - shift) - 1
        least = F.least(F.lit(SPAN), F.size(f["iw"]))
        worth = lambda i: F.when(F.get("w", i + shift) == F.get(f["iw"], i), F.lit(100 - percent)).otherwise(F.lit(-percent))
        no = F.lit(None).cast("int")

        def step(acc: Column, i: Column) -> Column:
            last = acc["last"] + worth(i) - F.when(i - least >= lo, worth(i - least)).otherwise(F.lit(0))
            best = F.when(i - lo + 1 >= least, F.greatest(acc["best"] + worth(i), last))  # greatest skips nulls
            return F.struct(last.alias("last"), best.alias("best"), (acc["ok"] | F.coalesce(best >= 0, F.lit(False))).alias("ok"))

        start = F.struct(F.lit(0).alias("last"), no.alias("best"), F.lit(False).alias("ok"))
        return F.aggregate(F.sequence(lo, hi), start, step, lambda acc: acc["ok"])

    joined = d.join(hits, same).join(items, "ih").filter(F.exists("shifts", lambda p: confirmed(F.struct("iw"), p)))
    out = joined.groupBy("key", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = scratch.write(out, "found")
    scratch.drop("hits")
    scratch.drop("items")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **how) -> DataFrame:
    """The clean rows of ``docs``, columns unchanged."""
    bad = contaminated(docs, benchmark, key, text, item, **how).select(F.col("key").alias("__key"), F.col("th").alias("__th"))
    return docs.join(bad, docs[key].eqNullSafe(bad["__key"]) & (F.xxhash64(docs[text]) == bad["__th"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **how) -> DataFrame:
    """One row per document: key, contaminated, n_items and items (comma-separated)."""
    bad = contaminated(docs, benchmark, key, text, item, **how)
    d = docs.select(F.col(key), F.xxhash64(text).alias("__th"))
    j = d.join(bad, d[key].eqNullSafe(bad["key"]) & (d["__th"] == bad["th"]), "left")
    return j.select(d[key], F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"))
