"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from two hashes of its name).
The shards take turns; at its turn a shard claims the first free slot of its permutation. Shards so own nearly equal numbers
of slots, and taking one out moves few slots of the others. Placing a row is one hash and one lookup in the broadcast table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: about a thousand slots a shard keep the shares within about one percent.
SLOTS = 65537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """Owner (position in shards) of every slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, so that every step visits every slot")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return np.array(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 48 bits of its MD5; null keys count as empty."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long"), F.lit(slots))


def table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard); one row a slot, so its size is fixed by the parameter."""
    owner = fill(shards, slots)
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots), "shard": np.array(shards, object)[owner]}), "slot long, shard string")


def place(rows: DataFrame, key: str | Column = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with columns slot and shard; no shuffle. Columns of these names are replaced.

    Equal keys share a shard, so choose a key with many values (an id); for a key that one value may fill, pass an
    expression that adds a second column. Null keys share the slot of the empty key.
    """
    value = F.col(key) if isinstance(key, str) else key
    placed = rows.withColumn("slot", slot_of(value, slots)).drop("shard")
    return placed.join(F.broadcast(table(rows.sparkSession, shards, slots)), "slot", "left")


def write(rows: DataFrame, path: str, key: str | Column = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """One folder a shard; rows stay in the task that read them, so a hot shard is several files."""
    place(rows, key, shards, slots).drop("slot").write.partitionBy("shard").parquet(path)


def oracle(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    owners = ", ".join(map(str, fill(shards, slots)))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH o AS (SELECT [{owners}] AS owner, [{names}] AS name),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {slots} AS slot FROM documents),
t AS (SELECT unnest(owner) AS k, generate_subscripts(owner, 1) - 1 AS slot, name FROM o)
SELECT doc_id, slot, name[k + 1] AS shard FROM d JOIN t USING (slot)
"""
