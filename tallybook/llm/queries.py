"""The registered queries of this folder: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, brown, contain, itq, licenses, secrets, sharding, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ";").alias("sentence_ids"), F.array_join("license_rules", ";").alias("license_rules"), F.array_join("licenses", ";").alias("licenses"), "license_rule", "license", "license_class")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), keep_ids=False)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = (toxicity.fold(F.col("doc_id")) == 0).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_bpe": op2_bpe,
    "op3_secrets": op3_secrets,
    "op4_sharding": op4_sharding,
    "op5_embeddings": op5_embeddings,
    "op6_urls": op6_urls,
    "op7_toxicity": op7_toxicity,
    "op8_brown": op8_brown,
    "op9_simhash": op9_simhash,
    "op10_containment": op10_containment,
}

ORACLES: dict[str, str] = {
    "op1_licenses": licenses.ORACLE,
    "op3_secrets": secrets.ORACLE,
    "op4_sharding": sharding.oracle(),
    "op6_urls": urls.ORACLE,
    "op10_containment": contain.ORACLE,
}
