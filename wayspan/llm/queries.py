"""Registered queries of the training-data operators, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm import decontamination, language, line_rules, near_dedup, packing, preferences, quality, sort_means, sql, surrogates, url_rules, whitening, winnowing, wrappers
from wayspan.llm.common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def remainder(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the session's ``spark.wayspan.surrogate.key``; the invented tables have one that is none."""
    return spark.conf.get("spark.wayspan.surrogate.key", "not a secret")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    trees = quality.fit(docs, labels)
    d = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), quality.score(trees, F.col("text"), spark).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = preferences.format_preferences(preferences.derived_pairs(table(spark, sf_dir, "conversations")))
    return d.withColumns({c: preferences.span_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    d = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), language.identify(filters, F.col("text"), spark).alias("r"))
    return d.select("doc_id", "held_out", "r.lang_pred", "r.score")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.report(table(spark, sf_dir, "embeddings"), k=8, dims=64, rounds=10, scale=1024, salt="3")


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "cleaned")


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(table(spark, sf_dir, "embeddings"), count=4, scale=256)
    return d.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op2_quality_trees": op2_quality_trees,
    "op3_preferences": op3_preferences,
    "op4_cutting_stock": op4_cutting_stock,
    "op5_winnowing": op5_winnowing,
    "op6_url_rules": op6_url_rules,
    "op7_spaced_seeds": op7_spaced_seeds,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_wrappers": op9_wrappers,
    "op10_language_masks": op10_language_masks,
    "op11_sort_means": op11_sort_means,
    "op12_line_rules": op12_line_rules,
    "op13_jacobi_whitening": op13_jacobi_whitening,
}

ORACLE = {k: v for k, v in sql.ORACLE.items() if k in QUERIES}
