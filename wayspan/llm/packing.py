"""Packing by cutting-stock column generation.

Every document's ids are cut at multiples of the sequence length; the full pieces are sequences of their own. The
remainders are counted by size class (a few hundred, whatever the corpus). Over that histogram a linear program picks
patterns of sizes that fill a sequence; a knapsack dynamic program prices new patterns. Rounded down, the patterns
take documents by their rank in their class; pieces that no well filled pattern takes are laid end to end and cut at
the sequences' ends. Only the histogram reaches the driver.

Nulls: a null text counts as empty, so its document is the end id alone. Repeated rows are packed once each. Nothing
is dropped: every id of every row lies in exactly one piece. A null doc_id stays null. Padding is what the last piece
of a sequence leaves: under one size class a piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch, bounded
from wayspan.llm.wordbpe import word_ids
from wayspan.session import ship

SEQUENCE, GRAIN, END_ID = 2048, 8, 1
LEAST_FILL = 0.98
_SHIFT = 44  # rank bits below the size class in a lookup key


def knapsack(y: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..size that fits in ``size``: its value and counts per size."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        value = best[c - 1 :: -1] + y[:c]
        s = int(value.argmax())
        if value[s] > best[c - 1] + 1e-12:
            best[c], last[c] = value[s], s + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(size), size
    while c > 0:
        s = last[c]
        if s:
            counts[s - 1] += 1
            c -= s
        else:
            c -= 1
    return float(best[size]), counts


def greedy(demand: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A basic solution to start from: largest sizes first, each pattern used until it exhausts a size."""
    m = len(demand)
    rest, open_, columns, amounts = demand.copy(), np.ones(m, bool), [], []
    while open_.any():
        col, room = np.zeros(m), m
        for s in np.flatnonzero(open_)[::-1] + 1:
            if n := min(room // s, max(1, math.ceil(rest[s - 1]))):
                col[s - 1], room = n, room - n * s
        used = np.flatnonzero(col)
        ratio = rest[used] / col[used]
        out = used[int(ratio.argmin())]
        columns.append(col)
        amounts.append(ratio.min())
        rest = np.maximum(rest - ratio.min() * col, 0)
        rest[~open_] = 0
        open_[out] = False
    return columns, np.array(amounts)


def inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan with row pivots: a few hundred rows, without the threads of a linear algebra library."""
    m = len(a)
    w = np.hstack([a.astype(float), np.eye(m)])
    for i in range(m):
        j = i + int(np.abs(w[i:, i]).argmax())
        w[[i, j]] = w[[j, i]]
        w[i] /= w[i, i]
        f = w[:, i].copy()
        f[i] = 0
        on = np.flatnonzero(f)
        w[on] -= f[on, None] * w[i]
    return w[:, m:]


def solve(demand: np.ndarray, iterations: int = 600) -> list[tuple[float, np.ndarray]]:
    """Basic patterns of the linear program as (amount, counts per size), by revised simplex.

    Patterns are priced at duals smoothed towards those of the best bound so far, which start at the sizes' own
    shares of a sequence. Every iterate is feasible, so stopping early costs some cuts and never pieces.
    """
    m = len(demand)
    d = demand + max(1e-4, 1e-5 * demand.mean()) * (1 + np.arange(m) / m)  # apart, so that ties don't stall it
    columns, x = greedy(d)
    inv = inverse(np.array(columns).T)
    cost = np.ones(m)
    centre, bound = np.arange(1, m + 1) / m, 0.0
    for i in range(iterations):
        y = np.einsum("i,ij->j", cost, inv)
        paid = 1.0
        if y.min() < -1e-9:
            col, paid = -np.eye(m)[int(y.argmin())], 0.0  # pieces of this size are worth nothing: leave slots empty
        else:
            for weight in (0.7, 0.0):
                price = weight * centre + (1 - weight) * np.maximum(y, 0)
                value, col = knapsack(price, m)
                if (lower := price @ d / max(value, 1e-9)) > bound:
                    bound, centre = lower, price / max(value, 1e-9)
                if y @ col > 1 + 1e-7:
                    break
            else:
                break
            if cost @ x <= bound * 1.0005:
                break
        way = np.einsum("ij,j->i", inv, col)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * way
        x[out] = ratio[out]
        columns[out], cost[out] = col, paid
        if i % 50 == 49:
            inv = inverse(np.array(columns).T)
            x = np.maximum(np.einsum("ij,j->i", inv, d), 0)
        else:
            row = inv[out] / way[out]
            inv = inv - np.outer(way, row)
            inv[out] = row
    return [(float(v), c) for v, c, paid in zip(x, columns, cost) if paid]


@dataclass
class Plan:
    """Where the pieces of each size class go, by rank: into slots of a pattern, or on the line that is cut last."""

    size: int  # of a sequence, in grains
    grain: int
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # class and first rank of each interval
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    sequences: int = 0

    def place(self, cls: np.ndarray, rank: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start in the piece, length, sequence, slot) of all parts; a piece has two at most."""
        if not len(cls):
            return
        row = np.arange(len(cls))
        at = np.searchsorted(self.starts, (cls << _SHIFT) | rank, "right") - 1
        k = rank - (self.starts[at] & ((1 << _SHIFT) - 1))
        line, a, b, c = self.rows[at].T
        flat, mult = line == 0, np.maximum(a, 1)
        yield row[flat], np.zeros(flat.sum(), np.int64), length[flat], (b + k // mult)[flat], (c + k % mult)[flat]
        grain_at = b + k * cls
        seq, slot = c + grain_at // self.size, grain_at % self.size
        head = np.minimum(length, (self.size - slot) * self.grain)
        yield row[~flat], np.zeros((~flat).sum(), np.int64), head[~flat], seq[~flat], slot[~flat]
        more = ~flat & (head < length)
        yield row[more], head[more], (length - head)[more], seq[more] + 1, np.zeros(more.sum(), np.int64)


def plan(counts: dict[int, int], size: int = SEQUENCE, grain: int = GRAIN, least: float = LEAST_FILL) -> Plan:
    """``counts``: pieces per size class, class c for lengths over (c - 1) * grain up to c * grain.

    Patterns that fill less than ``least`` of a sequence aren't used; their pieces go on the line, laid end to end and
    cut at every sequence's end.
    """
    m = size // grain
    have = np.zeros(m, np.int64)
    for c, n in counts.items():
        have[c - 1] = n
    if not have.sum():
        return Plan(m, grain)
    used, sizes = np.zeros(m, np.int64), np.arange(1, m + 1)
    starts, rows, sequence = [], [], 0

    def take(s: int, n: int, *what: int) -> None:
        starts.append((s << _SHIFT) | int(used[s - 1]))
        rows.append(what)
        used[s - 1] += n

    for v, col in solve(have.astype(float)):
        own = np.flatnonzero(col)
        n = min([math.floor(v + 1e-3), *(int((have[s] - used[s]) // col[s]) for s in own)])
        if n <= 0 or col @ sizes < least * m:
            continue
        slot = 0
        for s in own[::-1]:
            take(int(s) + 1, n * int(col[s]), 0, int(col[s]), sequence, slot)
            slot += int(col[s])
        sequence += n
    at = 0
    for s in range(m, 0, -1):
        if n := int(have[s - 1] - used[s - 1]):
            take(s, n, 1, 0, at, sequence)
            at += n * s
    order = np.argsort(starts)
    return Plan(m, grain, np.array(starts, np.int64)[order], np.array(rows, np.int64)[order], sequence + -(-at // m))


def pieces(docs: DataFrame, path: str, key: str, text: str, size: int, grain: int) -> DataFrame:
    """Full pieces (class 0) and remainders with their ids, each with its rank among those of its class in its task."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int, cls int, rank long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seen = word_ids(path), TaskContext.get().partitionId(), {}
        for b in batches:
            out = []
            for doc, t in zip(b[key], b[text]):
                ids = (encode.ids(t) if isinstance(t, str) else b"") + END_ID.to_bytes(2, "little")
                n = len(ids) // 2
                for start in range(0, n, size):
                    own = ids[2 * start : 2 * (start + size)]
                    length = len(own) // 2
                    c = 0 if length == size else -(-length // grain)
                    r = seen[c] = seen.get(c, -1) + 1
                    crc = zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes()) if c == 0 else 0
                    out.append((doc, start, length, crc, n, own if c else None, part, c, r))
            yield pd.DataFrame(out, columns=[key, "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "cls", "rank"])

    ship(docs.sparkSession)
    return docs.select(key, text).mapInPandas(cut, schema)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    p = scratch.write(pieces(docs, path, key, text, size, grain), "pieces")
    by_task = p.groupBy("part", "cls").agg(F.count("*").alias("n"))
    counts = {r["cls"]: r["n"] for r in bounded(by_task.groupBy("cls").agg(F.sum("n").alias("n")), size // grain + 1, "size classes")}
    laid = plan({c: n for c, n in counts.items() if c}, size, grain)
    held = spark.sparkContext.broadcast(laid)  # its size follows the number of size classes
    before = F.sum("n").over(W.partitionBy("cls").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_task.select("part", "cls", F.coalesce(before, F.lit(0)).alias("base"))
    p = p.join(offsets, ["part", "cls"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    kind = docs.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = b["ids"].to_numpy()
            for row, start, length, seq, slot in held.value.place(*(b[c].to_numpy(np.int64) for c in ("cls", "rank", "length"))):
                crc = [zlib.crc32(np.frombuffer(data[r], "<u2")[s : s + n].astype("<u4").tobytes()) for r, s, n in zip(row, start, length)]
                yield pd.DataFrame({key: b[key].to_numpy()[row], "start": b["start"].to_numpy()[row] + start, "length": length, "ids_crc32": crc, "doc_tokens": b["doc_tokens"].to_numpy()[row], "sequence_id": seq, "slot": slot})

    cols = [key, "start", "length", "ids_crc32", "doc_tokens"]
    placed = p.filter("cls > 0").select(key, "start", "length", "doc_tokens", "ids", "cls", "rank").mapInPandas(place, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.select(*cols, "sequence_id", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))
    full = p.filter("cls = 0").select(*cols, (F.col("rank") + laid.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
