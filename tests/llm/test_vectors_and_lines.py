"""Sort-means, line rules and whitening against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayspan.llm import line_rules, queries, sort_means, whitening

VECS = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def vectors(spark, rows, schema=VECS):
    return spark.createDataFrame(rows, schema)


def random_vectors(n, d, seed=0, spread=0.2):
    return np.random.default_rng(seed).normal(0, spread, (n, d)).astype(np.float32)


# 11 sort-means


def brute_clusters(rows, k, dims, rounds, scale, salt):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in starts]
    if not c:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        groups = defaultdict(list)
        for (_, v), j in zip(kept, at):
            groups[j].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else m for j, m in enumerate(c)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = defaultdict(int)
    for _, j, d in last:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in last), key=str)


EDGE_VECS = [(900, None), (901, [1.0] * 3), (902, [None] + [0.0] * 3), (903, [float("nan")] * 4), (904, [math.inf, 0.0, 0.0, 0.0]), (905, []), (None, [0.1, 0.2, 0.3, 0.4]), (906, [0.0] * 4), (906, [0.0] * 4), (907, [-0.0, 0.0, 0.0, 0.0])]


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(300, 8, 10), (40, 5, 3), (3, 8, 10)])
def test_sort_means_equals_brute_force(spark, n, k, rounds):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random_vectors(n, 4, n))] + [(i + 10_000, [0.25, 0.25, 0.0, 0.0]) for i in range(n // 2)] + EDGE_VECS
    df = vectors(spark, [(i, v, 0) for i, v in rows]).repartition(5)
    got = told(sort_means.report(df, k=k, dims=4, rounds=rounds, scale=1024, salt="3"))
    assert got == brute_clusters(rows, k, 4, rounds, 1024, "3")


def test_sort_means_is_exact_beyond_doubles(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random_vectors(60, 4, 5, 2e5))]
    got = told(sort_means.report(vectors(spark, [(i, v, 0) for i, v in rows]), k=4, dims=4, rounds=4, scale=1024, salt="3"))
    assert got == brute_clusters(rows, 4, 4, 4, 1024, "3")
    far = [(1, [3e38] * 4, 0), (2, [1.0] * 4, 0), (3, [2e15] * 4, 0)]
    assert {r.vec_id: r.distance for r in sort_means.report(vectors(spark, far), k=2, dims=4).collect()} == {2: 0, 3: 0}


def test_sort_means_empty_and_clashing_columns(spark):
    df = vectors(spark, [(1, [0.0] * 4, 7), (2, None, 8)]).withColumnRenamed("label", "cluster").withColumn("v", F.lit("x")).withColumn("id", F.lit(1)).withColumn("part", F.lit(2))
    assert told(sort_means.report(df, dims=4).select("vec_id", "cluster", "distance")) == [(1, 0, 0)]
    none = sort_means.report(df.filter("false"), dims=4)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_scan_from_any_last_assignment_finds_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, (500, 3)).astype(float)  # many ties
    c = sort_means.Centroids([[int(v) for v in r] for r in rng.integers(-5, 6, (7, 3))])
    for last in (np.zeros(500, int), rng.integers(0, 7, 500)):
        best, near = c.assign(x, last)
        d = ((x[:, None, :] - np.array(c.rows)[None]) ** 2).sum(2)
        assert (best == d.argmin(1)).all() and (near == d.min(1)).all()


# 12 line rules

LONG = "\n".join(f"Word{i % 613} of line {i} says thing{i % 31}." for i in range(6000))
TEXTS = [
    None, "", " \t\n ", "one two", "A sentence of words that ends well and is long enough to count as text for the rules here, surely so it does.",
    "Home | About | Contact | Help\nA sentence of words that ends well and is long enough to count as text for all the rules, surely so.",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z no mark at the end of it",
    "x y z w v u t s " * 6, "one two three four five six seven eight nine ten eleven twelve. " * 2 + "and more.",
    "same line here.\nsame line here.\n\nsame line here.\nother line of several words, to be long enough for the whole text.\nand another line with words in it.",
    "Wor### dsa*** reg&&& ood%%% but### not&&& the*** way%%% they### are&&& writ*** ten%%% her### eat&&& all*** but%%% the### ylo&&& ok*** bad%%%",
    "WOW!! THIS! IS! VERY! LOUD! AND! NOT! A! TEXT! THAT! ANY! ONE! WANTS! TO! READ! OR! KEEP! IN! A! CORPUS! OF! TEXTS!",
    "All rights reserved.\nA sentence of words that ends well and is long enough to count as text for the rules here, surely so it does.",
    "Licensed under the terms.\nRead more »\nMenu", "naïve façade “quoted words end here.”\r\nAnd the next one ends too, with enough words to pass the least number of them, or so.\x0b\x0cDone.", LONG,
]
LINES = "doc_id long, text string"


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    covered = {p for at in runs.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), failed


def brute_rule(line):
    ws = re.findall(r"[^\x20\x09-\x0D]+", line)
    seps = sum(w in line_rules.SEPARATORS for w in ws)
    low = line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    label = "".join(ch for ch in low if ch not in ".:>»…›|\t\n\x0b\x0c\r").strip(" ")
    if (seps >= 3 and 4 * seps >= len(ws)) or label in line_rules.LABELS:
        return "navigation"
    if len(ws) <= 30 and any(p in low for p in line_rules.PHRASES):
        return "boilerplate"
    if 100 * sum(ch in "#*$%&|<>" for ch in line) > 10 * sum(map(len, ws)):
        return "symbols"
    ended = line.rstrip(line_rules.AFTER + line_rules.BLANKS)[-1:] in tuple(line_rules.CLOSING)
    prose = len(ws) > 30 and any(w[-1] in line_rules.CLOSING for w in ws)
    if not (ended or prose) or 2 * sum(w[-1] in "!?" for w in ws) > len(ws):
        return "punctuation"
    return None


def test_line_rules_equal_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[5])]
    got = line_rules.judge(spark.createDataFrame(rows, LINES).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(-1))).collect()
    assert len(got) == len(rows)
    for r in got:
        *base, failed = brute_base(r.text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base, r.doc_id
        lines = [(x, brute_rule(x) if x.strip(line_rules.BLANKS) else None) for x in (r.text or "").split("\n")]
        lost = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x, rule in lines if rule)
        assert r.lost_chars == lost and r.base_failed == failed
        assert r.kept == (not failed and 100 * lost <= 50 * base[1])
        assert r.cleaned == (None if r.text is None else "\n".join(x for x, rule in lines if not rule))
        for rule, c in (("navigation", r.n_navigation), ("boilerplate", r.n_boilerplate), ("symbols", r.n_symbol_lines), ("punctuation", r.n_punctuation)):
            assert c == sum(x == rule for _, x in lines), (r.doc_id, rule)
    by = {r.doc_id: r.kept for r in got}
    assert [by[i] for i in (0, 1, 4, 5, 10, 11, 12, 15)] == [False, False, True, True, False, False, True, True]


def test_line_rules_of_an_empty_table_and_plan(spark):
    d = line_rules.judge(spark.createDataFrame([], LINES))
    assert d.count() == 0 and dict(d.dtypes)["n_words"] == "bigint" and dict(d.dtypes)["kept"] == "boolean"
    plan = queries.op12_line_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# 13 whitening


def brute_whitening(rows, count, scale):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(scale * np.array([[float(np.float32(c)) for c in v] for _, v in kept])).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:count], w[:, ::-1][:, :count]
    return [i for i, _ in kept], n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], (x - s / n) @ w / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("n", "d", "count"), [(300, 6, 4), (40, 17, 4), (30, 3, 4)])
def test_whitening_equals_eigenvectors(spark, n, d, count):
    base = random_vectors(n, d, d, 0.7) * np.linspace(1, 3, d, dtype=np.float32) + 2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(5000 + i, rows[0][1]) for i in range(n)]  # a hot vector counts once in the fit
    odd = [(901, None), (902, [None] + [0.0] * (d - 1)), (903, [math.nan] * d), (904, [math.inf] * d)]
    got = whitening.whiten(vectors(spark, [(i, v, 1) for i, v in rows + odd]).repartition(4), count=count).toPandas().sort_values(["vec_id", "component"])
    ids, m, far, y, share = brute_whitening(rows, min(count, d), 256)
    k = min(count, d)
    assert got["vec_id"].tolist() == [i for i in sorted(ids) for _ in range(k)] and set(got["n"]) == {m}
    assert [int(v) for v in got["deviation"][::k]] == [far[ids.index(i)] for i in sorted(ids)]
    white, want = got["whitened"].to_numpy().reshape(-1, k), y[np.argsort(ids)]
    for j in range(k):
        assert min(np.abs(white[:, j] - want[:, j]).max(), np.abs(white[:, j] + want[:, j]).max()) < 1e-8
    assert got["explained"].to_numpy()[:k] == pytest.approx(share, rel=1e-9) and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1


def test_whitening_without_variance_and_of_an_empty_table(spark):
    alike = vectors(spark, [(i, [0.5, 0.25], 0) for i in range(5)])
    for df in (alike, alike.filter("false"), alike.limit(1), vectors(spark, [(1, [], 0), (2, None, 0)])):
        d = whitening.whiten(df)
        assert d.count() == 0 and d.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = vectors(spark, [(i, [float(i), 2.0 * i], 0) for i in range(8)] + [(9, [1.0], 0), (None, [1.0, 2.0], 0)])
    d = whitening.whiten(line.withColumnRenamed("label", "component")).toPandas()  # one direction only
    assert set(d["component"]) == {1} and len(d) == 9 and d["explained"].iloc[0] == pytest.approx(1) and d["vec_id"].isna().sum() == 1


def test_whitening_of_large_entries_is_exact(spark):
    rows = [(i, [1e9 + i, 1e9 - 3.0 * i, float(i * i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).filter("component = 1").collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((20 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}


def test_rotations_make_columns_orthogonal():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 32):
        a = rng.normal(size=(d + 7, d)) * np.geomspace(1, 1e-7, d)
        r = np.linalg.qr(a, mode="r")
        s, v = whitening.jacobi(r)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-9)
    s, v = whitening.jacobi(np.zeros((4, 4)))
    assert (s == 0).all() and (v == np.eye(4)).all()


def test_registered_vector_queries(spark):
    src = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert told(queries.op11_sort_means(spark, SF)) == brute_clusters(src, 8, 64, 10, 1024, "3")
    d = queries.op13_jacobi_whitening(spark, SF)
    assert dict(d.dtypes)["deviation"] == "bigint" and d.count() == 4 * len(src)
    ids, m, far, y, share = brute_whitening(src, 4, 256)
    got = d.toPandas().sort_values(["vec_id", "component"])
    assert got["deviation"].tolist()[::4] == [far[ids.index(i)] for i in sorted(ids)] and got["explained"].to_numpy()[:4] == pytest.approx(share, rel=1e-9)
