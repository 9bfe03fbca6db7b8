"""Shared pieces: durable intermediate tables, skew-proof lookups, components, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import shared_dir

#: A key holding over 1/SHARE of all rows is handled apart; at most SHARE such keys exist.
SHARE = 1000

#: What bytes.split() splits at: \x20 and \x09-\x0D.
_SPACE = b" \t\n\x0b\x0c\r"

#: ASCII letters lower-cased, other ASCII signs but digits to spaces; bytes of other characters stay.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, ASCII case and punctuation removed; null gives none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between white space with A-Z lower-cased; null gives none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it again, so that lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallybook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tallybook_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more."""
    path = getattr(df, "tallybook_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts travel to Python in batches of few rows, so that long ones fit in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of numbers travel to Python many at a time, in what is run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever their case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """Joins a table unique on keys to left without letting one key fill a task.

    right has in column n how many rows of left hold its key; total: rows of left. Keys with over 1/SHARE of them,
    at most SHARE keys, are broadcast; all others are joined by key. Both tables should be materialized: each is read twice.
    """
    values = [c for c in right.columns if c not in keys and c != n]
    heavy = right.where(F.col(n) * SHARE > F.lit(total))
    marked = left.join(F.broadcast(heavy.select(*keys).withColumn("_heavy", F.lit(True))), keys, "left")
    hot = left.join(F.broadcast(heavy.select(*keys, *values)), keys, "inner")
    cold = marked.where(F.col("_heavy").isNull()).drop("_heavy").join(right.where(F.col(n) * SHARE <= F.lit(total)).select(*keys, *values), keys, how)
    return hot.unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of longs: one row (node, component) per node met, component its smallest node.

    Large-star and small-star rounds in turn; every round is a written table, no part of the graph reaches the driver.
    Null ends and loops are ignored; no edges give no rows.
    """
    pairs = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now, seen = materialize(pairs), None
    while True:
        n, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == seen or not n:
            break
        seen = (n, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = materialize(lookup_join(both, least, ["u"], "n", 2 * n, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = lookup_join(large, below, ["u"], "n", n, "inner").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(below.select("u", F.col("m").alias("v")))
        later = materialize(small.where("u <> v").distinct())
        for old in (now, least, large, below):
            discard(old)
        now = later
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
