"""Tables by name, and the views that present them as sightings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which event types stand for which kind of sighting.
ANNOUNCE, GET_PEERS, SAMPLE = "announce_peer", "get_peers", "sample"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> F.Column:
    """Seconds since 1970, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1e6D")


def sightings(events: DataFrame) -> DataFrame:
    """(seq, key, source, moment, peer): events as sightings of their user; only announces have a peer."""
    kind = F.col("event_type")
    source = F.when(kind == "purchase", ANNOUNCE).when(kind.isin("view", "click"), GET_PEERS).otherwise(SAMPLE)
    peer = F.when(kind == "purchase", F.get_json_object("props", "$.k").cast("long"))
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), source.alias("source"), epoch("ts").alias("moment"), peer.alias("peer"))


def documents(rows: DataFrame) -> DataFrame:
    """(doc_id, info_hash, name, paths, size, file_count): the first line is the name, each further line a path."""
    lines = F.split("text", "\n", -1)
    return rows.select(
        "doc_id",
        F.sha1(F.col("doc_id").cast("string")).alias("info_hash"),
        F.get(lines, F.lit(0)).alias("name"),
        F.slice(lines, F.lit(2), F.size(lines)).alias("paths"),
        F.col("n_chars").alias("size"),
        F.greatest(F.lit(1), F.size(lines) - 1).cast("long").alias("file_count"),
    )


def counter_keys(counts: DataFrame) -> DataFrame:
    """One row: how many keys the documents are dealt to, which is one more than the largest."""
    return counts.agg((F.max("key") + 1).alias("_keys"))


def with_counts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with the counters of the key they fall to (their number modulo the number of keys); none gives zeros. counts has a
    row per key, so it is small beside docs."""
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    dealt = docs.crossJoin(F.broadcast(counter_keys(counts)))
    joined = dealt.join(counts, F.pmod(F.col("doc_id"), F.col("_keys")) == F.col("key"), "left")
    return joined.select(*docs.columns, zero("seen_count", 0), zero("announce_count", 0), zero("first_seen", 0.0), zero("last_seen", 0.0))


def fingerprint(rows: DataFrame) -> str:
    """A name for the files a table is read from: it changes when one of them does."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, mark = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{int(mark or 0) % 2**64:016x}"
