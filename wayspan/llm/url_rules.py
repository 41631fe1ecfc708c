"""URL filters by a sort-merge range join over reversed-host keys.

A host's labels are reversed, each followed by a dot (``m.example.net`` gives ``net.example.m.``); a zero byte and the
path follow. A rule's host and path so become a prefix, and a prefix is an interval of keys: from the prefix up to it
followed by a byte above all others. Intervals nest or are disjoint. A url has one key for each of its host's parent
domains, itself included, with its own path; a rule fits the url if one of these keys lies in the rule's interval. One
sorted sweep over interval ends and keys keeps the stack of active rules: an end that opens a rule pushes it, one that
closes it brings back the rule that encloses it. The stack is linked (each rule knows the next one out), so a row holds
the innermost rule and not the whole stack, however many rules a host has. Of a url's keys the longest rule wins.

Nulls: a null url, or one without ``://``, has an empty host and path, which no rule fits. Rules with a null host,
path or verdict, or an empty host, match nothing. Repeated rules count once; of equally long fitting rules the one with
the longer host wins, then the smaller verdict. Empty tables give empty results, or the default verdict for every page.
Urls of any length are judged whole. Other columns are carried through, unless they bear the name of one of the four
results, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch, ascii_lower, shuffle_partitions

#: Rule hosts, and bytes of judged urls, up to which they are broadcast.
BROADCAST_HOSTS, BROADCAST_BYTES = 200_000, 32_000_000
SALTS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host up to ``/ ? #`` with A-Z lower-cased, the path from there up to ``? #``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def prefix(host: Column, path: Column) -> Column:
    """The key as bytes, which sort as the engine sorts them."""
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.concat(labels, F.lit("\0"), path).cast("binary")


def domains(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(rules: DataFrame) -> DataFrame:
    """Per host and path with a rule: its interval [lo, hi), itself, and the rule of the same host that encloses it.

    Enclosing paths are found by equality on a path's own prefixes, so no pairs of rules are tried.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().filter("host <> ''")
    r = r.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    shorter = F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring("path", F.lit(1), i - 1))
    inner = r.filter("path <> ''").select("host", "path", F.explode(shorter).alias("outer"))
    outer = inner.join(r.select("host", F.col("path").alias("outer"), F.col("verdict").alias("v")), ["host", "outer"])
    next_ = F.max_by(F.struct("host", F.col("outer").alias("path"), F.col("v").alias("verdict")), F.length("outer"))
    outer = outer.groupBy("host", "path").agg(next_.alias("outer"))
    lo = prefix(F.col("host"), F.col("path"))
    return r.join(outer, ["host", "path"], "left").select(lo.alias("lo"), F.concat(lo, F.lit(b"\xff")).alias("hi"), F.struct("host", "path", "verdict").alias("rule"), "outer")


def sweep(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (distinct, binary column key) that lie in a rule's interval, with the innermost such rule.

    The sort is by range over all partitions; the rule on top where a partition starts comes from the last interval end
    of those before it, one row a partition. Range bounds are sampled anew by every exchange, so the dealt-out events
    are written once and both the sweep and the boundaries read them from there.
    """
    n = shuffle_partitions(keys.sparkSession)
    ends = intervals(rules)
    top = lambda c: F.struct(F.col(c).alias("rule")).alias("top")  # noqa: E731  # a struct, so that no rule isn't no event
    none = F.lit(None).cast(ends.select(top("rule")).schema["top"].dataType)
    events = (
        ends.select(F.col("lo").alias("key"), F.lit(0).alias("kind"), top("rule"))
        .unionByName(ends.select(F.col("hi").alias("key"), F.lit(0).alias("kind"), top("outer")))
        .unionByName(keys.select("key", F.lit(1).alias("kind"), none.alias("top")))
    )
    scratch = Scratch(keys.sparkSession, "url_rules")
    events = events.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id())
    events = scratch.write(events, "events")
    here = W.partitionBy("part").orderBy("key", "kind")
    swept = events.withColumn("top", F.last("top", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)))
    last = events.filter("kind = 0").groupBy("part").agg(F.max_by("top", "key").alias("carry"))
    parts = events.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select("part", F.last("carry", ignorenulls=True).over(before).alias("carry"))
    out = swept.filter("kind = 1").join(F.broadcast(carry), "part", "left")  # one row a partition
    return out.select("key", F.coalesce("top", "carry")["rule"].alias("rule")).filter("rule is not null")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (``host`` followed by path, else null) and verdict."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = url_parts(F.col(url))
    p = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    p = p.select(*p.columns, host.alias("__host"), path.alias("__path"))
    urls = p.select("__host", "__path").filter("__host <> ''").distinct()
    keyed = urls.withColumn("__domain", F.explode(domains(F.col("__host"))))
    ruled = rules.select(ascii_lower(F.col("host")).alias("__domain")).dropna().distinct()
    if ruled.count() <= BROADCAST_HOSTS:  # else domains without rules are swept too and find none
        keyed = keyed.join(F.broadcast(ruled), "__domain", "left_semi")
    keyed = scratch.write(keyed.select("__host", "__path", prefix(F.col("__domain"), F.col("__path")).alias("key")), "keyed")
    found = keyed.join(sweep(keyed.select("key").distinct(), rules), "key")
    r = F.col("rule")
    rank = F.struct(F.length(r["host"]) + F.length(r["path"]), F.length(r["host"]))
    best = found.groupBy("__host", "__path").agg(F.max_by("rule", rank).alias("__rule"))
    best = scratch.write(best, "best")
    size = best.agg(F.sum(F.length("__host") + F.length("__path") + 100)).head()[0] or 0
    if size <= BROADCAST_BYTES:
        j = p.join(F.broadcast(best), ["__host", "__path"], "left")
    else:  # dealt out by url, those of one url in SALTS parts
        salted = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = p.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__path", "__salt"], "left")
    keep = [c for c in p.columns if not c.startswith("__")]
    rule, verdict = F.col("__rule")["host"], F.coalesce(F.col("__rule")["verdict"], F.lit(default))
    return j.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.concat(rule, F.col("__rule")["path"]).alias("rule"), verdict.alias("verdict"))
