"""Crawl planning over recorded nodes (A28, I13) and checks of what comes in."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import address

# Seconds between bootstraps of a family, most nodes, most connections, sources of a sighting, listed files.
BOOTSTRAP_SECONDS, MOST_NODES, MOST_CONNECTIONS, LISTED = 2.0, 64, 1024, 200
SOURCES = ("get_peers", "announce_peer", "sample")


def plan(queue: DataFrame, backoff: DataFrame, sockets: dict[int, int], now: float, batch: int) -> DataFrame:
    """What is sent in one step: of each family's queue (family, seq, node_id, ip, port) the oldest, up to batch rows for each of
    its sockets; addresses that are to be left in peace (ip, port, until) are asked for nodes only. I13: with the socket."""
    sizes = F.create_map(*[F.lit(x) for pair in sockets.items() for x in pair])
    own = F.try_element_at(sizes, F.col("family"))
    turn = F.row_number().over(Window.partitionBy("family").orderBy("seq"))
    taken = queue.withColumn("turn", turn).where(F.col("turn") <= F.coalesce(own, F.lit(0)) * batch)
    rest = backoff.groupBy("ip", "port").agg(F.max("until").alias("until")).where(F.col("until") > now)
    query = F.when(F.col("until").isNotNull(), "find_node").otherwise("sample_infohashes")
    return taken.join(rest, ["ip", "port"], "left").select("family", "seq", "node_id", "ip", "port", query.alias("query"), round_robin(F.col("turn") - 1, own).alias("socket"))


def round_robin(turn: Column, sockets: Column) -> Column:
    """Sockets take turns."""
    return F.pmod(turn, sockets)


def starving(families: DataFrame, queue: DataFrame, now: float) -> DataFrame:
    """Families (family, last_bootstrap) with nothing in the queue whose last bootstrap is long enough ago."""
    return families.join(queue.select("family"), "family", "left_anti").where(F.lit(now) - F.col("last_bootstrap") >= BOOTSTRAP_SECONDS)


def checked_sightings(obs: DataFrame, first_of: list[str] | None = None) -> DataFrame:
    """Sightings (info_hash, source, seq, ...) with a column reject: why a row isn't one, else null; and created: whether it is
    the first good one of its hash."""
    reject = F.when(F.coalesce(F.octet_length("info_hash"), F.lit(0)) != 20, "length").when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "source")
    rows = obs.withColumn("reject", reject)
    first = rows.where("reject is null").groupBy("info_hash").agg(F.min("seq").alias("_first"))
    created = F.col("reject").isNull() & (F.col("seq") == F.col("_first"))
    return rows.join(first, "info_hash", "left").withColumn("created", F.coalesce(created, F.lit(False))).drop("_first")


def checked_metadata(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """Metadata rows with a column reject: why a record can't be one, else null."""
    n = F.size(F.coalesce("files", F.array().cast(rows.schema["files"].dataType)))
    low = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    reject = F.when(low("total_size", 0), "total_size").when(low("piece_length", 1), "piece_length").when(low("file_count", 1), "file_count").when((n < 1) | (n > F.least("file_count", F.lit(listed))), "files")
    return rows.withColumn("reject", reject)


def settings_error(**given: object) -> str | None:
    """The first setting that is out of its range, as a message, or None. Missing settings count as good."""
    number = lambda v: isinstance(v, int | float) and math.isfinite(v)
    port, nodes = given.get("port", 0), given.get("nodes", 1)
    checks = (
        ("port", lambda v: 0 <= v <= 65535, "must be between 0 and 65535"),
        ("nodes", lambda v: 1 <= v <= MOST_NODES, f"must be between 1 and {MOST_NODES}"),
        ("port", lambda v: v == 0 or v + nodes - 1 <= 65535, "plus --nodes exceeds port 65535"),
        ("web_host", bool, "must not be empty"),
        ("web_port", lambda v: 0 <= v <= 65535, "must be between 0 and 65535"),
        ("duration", lambda v: v is None or (number(v) and v >= 0), "must be a finite number that is not negative"),
        ("fetch_workers", lambda v: 1 <= v <= MOST_CONNECTIONS, f"must be between 1 and {MOST_CONNECTIONS}"),
        ("batch_size", lambda v: v >= 1, "must be at least 1"),
        ("interval", lambda v: number(v) and v > 0, "must be a finite number greater than 0"),
        ("database", bool, "must not be empty"),
        ("database", lambda v: Path(str(v)).resolve().parent.is_dir(), "directory does not exist"),
    )
    values = given | {"port": port}
    return next((f"--{name.replace('_', '-')} {why}" for name, good, why in checks if name in values and not good(values[name])), None)


def usable(nodes: DataFrame, own_suffixes: list[bytes], ip6: bool = False, keep: Column | None = None) -> DataFrame:
    """Nodes (node_id, ip, port) that may be asked; `keep` is a further filter."""
    found = nodes.where(address.is_foreign(F.col("node_id"), F.col("ip"), F.col("port"), own_suffixes, ip6))
    return found if keep is None else found.where(keep)
