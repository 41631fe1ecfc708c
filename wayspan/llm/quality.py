"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles of a bounded labelled sample; each tree is grown level by level from
gradient histograms, then all trees are flattened into arrays (feature, bin, child) that numpy walks for a whole batch
of documents at once.

Nulls: a null text counts as empty and is scored like one. Labels that are null are left out; a document with several
labels counts once, with the least. Without any usable label every score is 0.5. Rows that tie or repeat get equal
scores. ``max_rows`` bounds the labelled rows that a fit uses, picked evenly by a hash of the document's id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.session import ship

MAX_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "sd_word", "upper", "digit", "punct", "pipe", "bang", "symbol", "stop", "space", "newline", "high",
    "entropy", "distinct_words", "top_word", "repeat_next", "one_char", "bare", "tail_mark", "capital", "all_caps", "lines", "mean_line", "distinct_lines", "short_lines", "long_words", "quote",
)


def statistics(text: str | None) -> list[float]:
    """The document's numbers, in the order of FEATURES."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(len(raw), 1)
    hist = np.bincount(raw, minlength=256)
    of = lambda chars: float(sum(hist[ord(c)] for c in chars)) / n
    share = hist[hist > 0] / n
    ws = text.split()
    nw = max(len(ws), 1)
    lens = np.fromiter(map(len, ws), np.int64, len(ws)) if ws else np.zeros(1, np.int64)
    counts = Counter(ws)
    lines = [x for x in text.split("\n") if x]
    nl = max(len(lines), 1)
    return [
        math.log1p(len(text)), math.log1p(len(ws)), float(lens.mean()), math.log1p(int(lens.max())), float(lens.std()),
        float(hist[65:91].sum()) / n, float(hist[48:58].sum()) / n, float(hist[33:48].sum() + hist[58:65].sum()) / n, of("|"), of("!"), of("#$%&*"), of(".,"), of(" "), of("\n"), float(hist[128:].sum()) / n,
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        len(counts) / nw, max(counts.values(), default=0) / nw, sum(map(str.__eq__, ws[1:], ws)) / nw, float((lens == 1).sum()) / nw,
        sum(map(str.isalpha, ws)) / nw, sum(w[-1] in "#$%&*!|" for w in ws) / nw, sum(w[0].isupper() for w in ws) / nw, sum(map(str.isupper, ws)) / nw,
        math.log1p(len(lines)), math.log1p(len(text) / nl), len(set(lines)) / nl, sum(len(x) < 20 for x in lines) / nl, float((lens > 12).sum()) / nw, of("\"'"),
    ]


def matrix(texts: Iterator[str | None]) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class Trees:
    """All trees end to end: a node sends a row left where bin <= cut, and leaves point at themselves."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + math.exp(-self.base)))
        b, total = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(b[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, n_bins: int = 64, least: int = 20, l2: float = 1.0) -> Trees:
    """Fit by Newton boosting of the logistic loss."""
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    t = Trees(edges, *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0), np.zeros(0, np.int64), depth, math.log(mean / (1 - mean)))
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        return t
    b = t.bins(x).astype(np.int64)
    n, m = b.shape
    flat = b + np.arange(m) * n_bins  # one histogram for all features
    f = np.full(n, t.base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        first = len(feature)
        roots.append(first)
        feature.append(0), cut.append(0), left.append(first), right.append(first), value.append(0.0)
        at, front = np.full(n, first), [first]
        for level in range(depth + 1):
            slot = {node: i for i, node in enumerate(front)}
            k = len(front)
            where = np.array([slot.get(i, -1) for i in range(first, len(feature))])[at - first]
            on = np.flatnonzero(where >= 0)
            if not len(on):
                break
            gs, hs = np.bincount(where[on], g[on], k), np.bincount(where[on], h[on], k)
            for node, i in slot.items():
                value[node] = rate * gs[i] / (hs[i] + l2)
            if level == depth:
                break
            cell = (where[on, None] * (m * n_bins) + flat[on]).ravel()
            shape = (k, m, n_bins)
            size = math.prod(shape)
            gl = np.bincount(cell, np.repeat(g[on], m), size).reshape(shape).cumsum(2)
            hl = np.bincount(cell, np.repeat(h[on], m), size).reshape(shape).cumsum(2)
            nl = np.bincount(cell, minlength=size).reshape(shape).cumsum(2)
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(k, -1).argmax(1)
            nxt = []
            for node, i in slot.items():
                j, c = divmod(int(best[i]), n_bins)
                if gain[i, j, c] <= 1e-9:
                    continue
                feature[node], cut[node] = j, c
                left[node], right[node] = len(feature), len(feature) + 1
                for _ in range(2):
                    me = len(feature)
                    nxt.append(me)
                    feature.append(0), cut.append(0), left.append(me), right.append(me), value.append(0.0)
                mine = on[where[on] == i]
                at[mine] = np.where(b[mine, j] <= c, left[node], right[node])
            if not nxt:
                break
            front = nxt
        f += np.array(value[first:])[at - first]
    return Trees(edges, *(np.array(v, np.int64) for v in (feature, cut, left, right)), np.array(value), np.array(roots, np.int64), depth, t.base)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, quality) of at most about ``max_rows`` labelled documents."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("__y"))
    n = known.count()
    if n > max_rows:  # evenly by hash; the expected number is max_rows
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    # At most about max_rows rows of two numbers, so the documents need no shuffle.
    return docs.select(key, F.col(text).alias("__t")).join(F.broadcast(known), key).select("__t", "__y")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS, **how) -> Trees:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["__t"])
            yield pd.DataFrame({"x": list(x), "y": b["__y"].astype("double")})

    ship(docs.sparkSession)
    rows = labelled(docs, labels, text, key, max_rows).mapInPandas(sums, "x array<double>, y double").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"]))  # the same trees whatever the order of arrival
    return grow(x[order], rows["y"].to_numpy(np.float64)[order], **how)


def score(trees: Trees, text: Column, spark) -> Column:
    """Score of each text, by numpy over Arrow batches."""
    ship(spark)
    held = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(held.value.score(matrix(s)))

    return scored(text)
