"""Snapshots and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(attempts: DataFrame) -> DataFrame:
    """Failed attempts by reason."""
    return attempts.where(F.col("outcome") != "ok").groupBy("outcome").agg(F.count("*").alias("attempts")).select(F.concat(F.lit("fetch_fail_"), F.col("outcome")).alias("metric"), F.col("attempts").alias("value"))


def long_form(one_row: DataFrame) -> DataFrame:
    """(metric, value) of a row of numbers."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns]))
    return one_row.select(each.alias("m")).select("m.*")


def union(parts: list[DataFrame]) -> DataFrame:
    """Metrics of several snapshots; of a name given twice, the later part's wins."""
    ranked = [p.select("metric", F.col("value").cast("double").alias("value"), F.lit(k).alias("_k")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).groupBy("metric").agg(F.max_by("value", "_k").alias("value"))


def backlog(documents: DataFrame, counters: DataFrame, dropped: Column | int = 0) -> DataFrame:
    """Rows that wait to be written."""
    waiting = documents.agg(F.count("*").alias("backlog_documents")).crossJoin(counters.agg(F.count("*").alias("backlog_counters")))
    return long_form(waiting.withColumn("backlog_dropped", F.lit(dropped)))


def index_metrics(turns: DataFrame, store_totals: DataFrame) -> DataFrame:
    """The totals of the store as the last refresh saw them, with the number of refreshes and of errors so far; turns is what
    flushing.turns gives."""
    seen = turns.agg(F.count(F.when(F.array_contains(F.split("done", ","), "totals"), 1)).alias("refreshes"), F.coalesce(F.max("errors"), F.lit(0)).alias("errors"))
    return long_form(store_totals.crossJoin(seen))
