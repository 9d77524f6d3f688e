"""The operators' queries, by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, chat, decontam, divergence, langid, mixing, neighbours, quality, resampling, secrets, simhash, toxicity, urls
from .common import table


def op1_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"))


def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_chat_format(spark: SparkSession, d: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.as_events(chat.with_probe(spark, table(spark, d, "conversations")))))


def op4_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    s = secrets.scan(table(spark, d, "documents"))
    n = lambda k: F.size(F.filter("base", lambda r: r["kind"] == k)).cast("long")
    live = F.size(F.filter("spans", lambda r: ~r["example"])).cast("long").alias("n_live")
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"), live)


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.predicted(table(spark, d, "documents"))


def op7_simhash(spark: SparkSession, d: str) -> DataFrame:
    x = simhash.near_duplicates(table(spark, d, "documents"))
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judged(table(spark, d, "pages"), urls.outcomes(table(spark, d, "labels")))


def op9_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return bwt.deduplicated(table(spark, d, "documents")).drop("removed")


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def op11_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "embeddings"))


def op12_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audited(table(spark, d, "documents"))


def op13_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resampled(table(spark, d, "documents"), table(spark, d, "benchmark"))


def quality_base(spark: SparkSession, d: str) -> DataFrame:
    """What of op2 SQL can say: the base counts and verdict."""
    return op2_quality_rules(spark, d).drop("score", "kept")


def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    """What of op4 SQL can say: base spans by kind."""
    return op4_secret_scan(spark, d).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, d: str) -> DataFrame:
    """What of op1 SQL can say: each source's size and target."""
    return mixing.planned(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mix, op2_quality_rules, op3_chat_format, op4_secret_scan, op5_decontamination, op6_language_id, op7_simhash, op8_url_filter, op9_suffix_dedup, op10_toxicity, op11_neighbours, op12_source_divergence, op13_importance_resampling, quality_base, secret_counts, mix_targets, pipeline)}
ORACLES: dict[str, str] = {"op3_chat_format": chat.ORACLE, "op8_url_filter": urls.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_importance_resampling": resampling.ORACLE, "quality_base": quality.BASE_ORACLE, "secret_counts": secrets.COUNT_ORACLE, "mix_targets": mixing.TARGET_ORACLE}
