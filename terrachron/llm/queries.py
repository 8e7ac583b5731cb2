"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, jaccard, mixing, pii, quality, secret_scan, sharding, toxicity, url_filter
from .common import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(table(spark, sf_dir, "documents"))
    show = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda i: F.size(F.filter("spans", lambda x: x["rank"] == i)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(pii.KINDS))
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", show), ",").alias("spans"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))


def op6_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(sharding.with_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")))
    layout = sharding.rewrite(spark, rows, sharding.scratch_root(spark))
    # sizes and checksums are those of the texts in the files
    there = sharding.with_bytes(sharding.read_layout(spark, rows, layout))
    return there.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join("near_items", ",").alias("near_items"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_secret_scan,
        op3_toxicity,
        op4_personal_data,
        op5_source_mixing,
        op6_flow_resharding,
        op7_ngram_jaccard_join,
        op8_quality_classifier,
        op9_benchmark_decontamination,
        op10_url_filter,
    )
}

SQL = {"op2_secret_scan": secret_scan.scan_sql(), "op7_ngram_jaccard_join": jaccard.JACCARD_SQL, "op5_source_mixing": mixing.MIX_SQL, "op9_benchmark_decontamination": decontaminate.CONTAMINATION_SQL, "op10_url_filter": url_filter.JUDGE_SQL}
