"""Language identification by language-bitmask n-gram filters.

Each language's frequent letter n-grams go into a Bloom filter; the filters are bit-sliced, so that one word per
position holds a bit per language and the AND of an n-gram's positions gives at once all languages that have it. A
text's n-grams are counted per bit; each count is corrected for the rate at which that language's slice answers
falsely, and the largest share decides.

A text's n-grams are those of its words, each with a space on both sides, so they depend on the text alone: not on the
texts beside it in a batch. An n-gram enters a language's filter only with a share of at least ``least`` of that
language's n-grams, so a filter holds at most ``len(orders) / least`` of them, and only where its share is at least
``ratio`` times that of the language that has it most, so a stray foreign word doesn't blur the filters.

``max_docs`` bounds the texts per language that a fit reads: distinct texts, picked evenly by a hash of the text and
counted whole; copies of a text teach once. The filters have a bit for every language of the training rows; more than
``max_langs`` of them (not a cap on any real set of languages, but a guard against a column that isn't one) is an error.

Nulls: a null text, or one without any letter, is ``und`` with score 0. Rows without a language teach nothing. Ties go
to the language with more training documents, then to the smaller name. Without any training row all texts are
``und``. Repeated rows get equal results. Very long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch, bounded
from wayspan.session import ship

ORDERS, LEAST, RATIO, MAX_DOCS, PROBES = (3, 4), 2e-5, 0.2, 4000, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Per code point: itself where it is a letter, else a space."""
    if not _letters:
        t = np.arange(0x110000, dtype=np.uint32)
        t[[not chr(c).isalpha() for c in range(0x110000)]] = 32
        _letters.append(t)
    return _letters[0]


def grams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: hashes of the n-grams of every word with a space on both sides, and the text each is from."""
    lens = np.array([len(t) for t in texts], np.int64) + 2
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_table()[np.minimum(codes, 0x10FFFF)]
    owner = np.repeat(np.arange(len(texts)), lens)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])  # a text's run of non-letters is one space
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        inner = owner[: len(h)] == owner[n - 1 :]
        for i in range(n):
            part = codes[i : len(codes) - n + 1 + i]
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                inner &= part != 32  # n-grams lie in one word, with its edges
        yield h[inner], owner[: len(h)][inner]


@dataclass
class Filters:
    langs: list[str]
    slices: np.ndarray  # (words, positions) of uint64; bit l % 64 of word l // 64 is language l
    false_rate: np.ndarray
    orders: tuple[int, ...]

    def positions(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(self.slices.shape[1] - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) & mask).astype(np.int64)

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.langs)
        hits, total = np.zeros((k, n)), np.zeros(n)
        lower = [(t or "").lower() for t in texts]
        for h, owner in grams(lower, self.orders):
            total += np.bincount(owner, minlength=n)
            at = list(self.positions(h))
            for w in range(self.slices.shape[0]):
                got = self.slices[w][at[0]]
                for p in at[1:]:
                    got &= self.slices[w][p]
                for lang in range(64 * w, min(k, 64 * w + 64)):
                    bit = (got >> np.uint64(lang % 64)) & np.uint64(1)
                    hits[lang] += np.bincount(owner, bit, n)
        true = np.maximum(0, (hits - total * self.false_rate[:, None]) / (1 - self.false_rate[:, None])) + 1e-9
        best = true.argmax(0) if k else np.zeros(n, int)
        score = true[best, np.arange(n)] / true.sum(0) if k else np.zeros(n)
        spoken = [k > 0 and any(map(str.isalpha, t)) for t in lower]
        return [self.langs[b] if s else "und" for b, s in zip(best, spoken)], np.where(spoken, score, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = ORDERS, least: float = LEAST, ratio: float = RATIO, max_docs: int = MAX_DOCS, max_langs: int = 100_000) -> Filters:
    """Filters from the rows of ``docs``; only ``text`` and ``lang`` are read."""
    spark = docs.sparkSession
    d = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    scratch = Scratch(spark, "language")
    seen = scratch.write(d.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("t")).alias("texts")), "seen")
    langs = [r["l"] for r in sorted(bounded(seen, max_langs, "languages"), key=lambda r: (-r["n"], r["l"]))]
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), orders)
    d = d.join(F.broadcast(seen.select("l", "texts")), "l")  # a row a language
    d = d.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) < 1_000_003 * F.least(F.lit(1.0), F.lit(max_docs) / F.col("texts"))).select("l", "t").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, own in b.groupby("l"):
                for n, (h, _) in zip(orders, grams([x.lower() for x in own["t"]], orders)):
                    key, c = np.unique(h.view(np.int64), return_counts=True)
                    yield pd.DataFrame({"l": name, "n": n, "g": key, "c": c})

    ship(spark)
    c = scratch.write(d.mapInPandas(count, "l string, n int, g long, c long").groupBy("l", "n", "g").agg(F.sum("c").alias("c")), "counts")
    total = c.groupBy("l", "n").agg(F.sum("c").alias("total"))  # a row a language and order
    share = c.join(F.broadcast(total), ["l", "n"]).select("l", "n", "g", (F.col("c") / F.col("total")).alias("p")).filter(F.col("p") >= least)
    top = F.max("p").over(W.partitionBy("n", "g"))
    # At most 1 / least rows a language and order, by construction: their shares sum to one.
    kept = share.withColumn("top", top).filter(F.col("p") >= ratio * F.col("top")).select("l", "g").toArrow()
    names, g = kept["l"].to_numpy(), kept["g"].to_numpy().view(np.uint64)
    m = 1 << max(10, math.ceil(math.log2(16 * max(1, len(np.unique(g))))))
    f = Filters(langs, np.zeros(((len(langs) + 63) // 64, m), np.uint64), np.zeros(len(langs)), orders)
    at = {x: i for i, x in enumerate(langs)}
    which = np.fromiter((at[x] for x in names), np.int64, len(names))
    for p in f.positions(g):
        np.bitwise_or.at(f.slices, (which // 64, p), np.uint64(1) << (which % 64).astype(np.uint64))
    for i in range(len(langs)):
        f.false_rate[i] = float(((f.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES
    scratch.clear()
    return f


def identify(filters: Filters, text: Column, spark) -> Column:
    """Struct (lang_pred, score) of each whole text."""
    ship(spark)
    held = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            names, scores = [], []
            at, size = 0, 0
            texts = list(s)
            for i, t in enumerate(texts):  # a few million characters at a time
                size += len(t or "")
                if size > 2_000_000 or i == len(texts) - 1:
                    a, b = held.value.classify(texts[at : i + 1])
                    names += a
                    scores += list(b)
                    at, size = i + 1, 0
            yield pd.DataFrame({"lang_pred": names, "score": pd.Series(scores, dtype="float64")})

    return named(text)
