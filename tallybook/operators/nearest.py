"""Nearest identifiers by XOR distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = 5


def xor_distance(hex_id: Column, target: Column) -> list[Column]:
    """The 160-bit distance as five unsigned 32-bit numbers, highest first; their order is that of the distances."""
    part = lambda h, k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    return [part(hex_id, k).bitwiseXOR(part(target, k)) for k in range(CHUNKS)]


def nearest(nodes: DataFrame, target: str, k: int, id_col: str = "node_id", seq: str = "seq") -> DataFrame:
    """The k nodes nearest to a target (40 hex digits), ties in input order; one top-k, nothing is crossed."""
    names = [f"x{i}" for i in range(CHUNKS)]
    measured = nodes.withColumns(dict(zip(names, xor_distance(F.col(id_col), F.lit(target)), strict=True)))
    return measured.orderBy(*names, seq).limit(k)


def shortlist(nodes: DataFrame, queried: DataFrame, target: str, k: int = 32) -> DataFrame:
    """the latest address of every node id, those asked already left out, the k nearest kept."""
    newest = nodes.groupBy("node_id").agg(F.max_by(F.struct("ip", "port", "seq"), "seq").alias("n")).select("node_id", "n.*")
    return nearest(newest.join(queried.select("ip", "port").distinct(), ["ip", "port"], "left_anti"), target, k)


def peers_found(replies: DataFrame) -> DataFrame:
    """distinct peers of each lookup, in order of address and port."""
    return replies.groupBy("lookup").agg(F.array_sort(F.collect_set(F.struct("ip", "port"))).alias("peers"))
