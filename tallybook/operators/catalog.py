"""The catalog over recorded sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.sources.tables import ANNOUNCE

# Kept peers, attempts, lookups, retry step, shares of an eviction.
MAX_PEERS, MAX_ATTEMPTS, MAX_LOOKUPS, RETRY_SECONDS, EVICTION_SHARE = 32, 3, 2, 30.0, 20


def counters(obs: DataFrame) -> DataFrame:
    """Per key the sightings, announces, moment of the first arrival (not the least) and the latest moment."""
    return obs.groupBy("key").agg(
        F.count("*").alias("seen_count"),
        F.count(F.when(F.col("source") == ANNOUNCE, 1)).alias("announce_count"),
        F.min_by("moment", "seq").alias("first_seen"),
        F.max("moment").alias("last_seen"),
    )


def recent(rows: DataFrame, scope: list[str], item: list[str], seq: str, limit: int) -> DataFrame:
    """The last `limit` distinct items of each scope by their last touch; column touched is when that was.

    The last touches are found by a map-side aggregate first, so a hot scope sends distinct items only.
    """
    touched = rows.groupBy(*scope, *item).agg(F.max(seq).alias("touched"))
    newest = Window.partitionBy(*scope).orderBy(F.desc("touched"))
    return touched.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= limit).drop("_age")


def recent_peers(obs: DataFrame, limit: int = MAX_PEERS) -> DataFrame:
    """Per key its newest distinct peers, least recent first."""
    kept = recent(obs.where(F.col("peer").isNotNull()), ["key"], ["peer"], "seq", limit)
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("touched", "peer"))), lambda x: x["peer"]).alias("peers"))


def latest(rows: DataFrame, keys: list[str], values: list[str], seq: str) -> DataFrame:
    """The values of the latest row of each key."""
    return rows.groupBy(*keys).agg(*[F.max_by(v, seq).alias(v) for v in values])


def without_failed(peers: DataFrame, failed: DataFrame) -> DataFrame:
    """Peers of a key less those that failed for it."""
    return peers.join(failed.select("key", "peer").distinct(), ["key", "peer"], "left_anti")


def cumulative(live: DataFrame, base: DataFrame) -> DataFrame:
    """Counters of a run on top of the stored ones; the earliest first moment known wins."""
    b = base.select("key", *[F.col(c).alias(f"_{c}") for c in ("seen_count", "announce_count", "first_seen")])
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    return live.join(b, "key", "left").select("key", add("seen_count"), add("announce_count"), F.least("first_seen", "_first_seen").alias("first_seen"), "last_seen")


def queue_of(state: Column, checked: Column, peers: Column, looking: Column, lookups: Column) -> Column:
    """The queue an entry waits in, or null."""
    ready = (state == "pending") & checked
    return (
        F.when((state == "pending") & ~checked, "needs_check")
        .when(ready & (peers > 0), "fetchable")
        .when(ready & ~looking & (lookups < MAX_LOOKUPS), "needs_lookup")
    )


def gate(entries: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """New keys against the stored table: found ones are done and carry its counters as base, others are fetchable."""
    base = stored.select(key, F.col("seen_count").alias("base_seen"), F.col("announce_count").alias("base_announce"), F.lit(True).alias("_known"))
    joined = entries.join(base, key, "left")
    return joined.withColumn("fetch_state", F.when(F.col("_known"), "done").otherwise(F.col("fetch_state"))).withColumn("checked", F.lit(True)).drop("_known")


def state_counts(entries: DataFrame) -> DataFrame:
    """Entries per state; they add up to all entries."""
    return entries.groupBy("fetch_state").agg(F.count("*").alias("entries"))


def global_counters(entries: DataFrame, obs: DataFrame, evictions: DataFrame | None = None) -> DataFrame:
    """One row: hashes seen and discovered (an entry that came back after its eviction counts again), observations, evictions,
    entries by state, those done by the store alone, bytes of the metadata held. The states add up to the hashes seen."""
    state = lambda s: F.count(F.when(F.col("fetch_state") == s, 1)).alias(f"fetch_{s}")
    own = F.col("fetch_state") == "done"
    row = entries.agg(
        F.count("*").alias("hashes_seen"), *[state(s) for s in ("pending", "in_progress", "done", "failed")],
        F.count(F.when(own & F.col("known_from_store"), 1)).alias("known_done"), F.coalesce(F.sum(F.when(own & ~F.col("known_from_store"), F.col("metadata_size"))), F.lit(0)).cast("long").alias("metadata_bytes"),
    )
    row = row.crossJoin(obs.agg(F.count("*").alias("observations")))
    if evictions is None:
        return row.withColumns({"evicted": F.lit(0).cast("long"), "hashes_discovered": F.col("hashes_seen")})
    # Every entry that is there was created once more than it was evicted; one that is gone, as often.
    return row.crossJoin(evictions.agg(F.count("*").alias("evicted"))).withColumn("hashes_discovered", F.col("hashes_seen") + F.col("evicted"))


def fetch_candidates(entries: DataFrame, limit: int) -> DataFrame:
    """the fetchable entries seen most, latest first among equals."""
    return entries.where(F.col("queue") == "fetchable").orderBy(F.desc("seen_count"), F.desc("last_seen"), "key").limit(limit)


def lookups_due(entries: DataFrame, now: float, limit: int) -> DataFrame:
    """Entries in need of peers whose wait is over, newest touch first."""
    return entries.where((F.col("queue") == "needs_lookup") & (F.col("next_lookup_time") <= now)).orderBy(F.desc("touched"), "key").limit(limit)


def oldest(rows: DataFrame, seq: str, limit: int) -> DataFrame:
    """a first-in first-out drain."""
    return rows.orderBy(seq).limit(limit)


def bounded_queue(rows: DataFrame, seq: str, limit: int) -> DataFrame:
    """What a queue of `limit` keeps when its oldest rows are dropped; a top-k, so no task sorts all rows."""
    return rows.orderBy(F.desc(seq)).limit(limit)


def is_evictable(state: Column, looking: Column) -> Column:
    """Entries that nothing works on: neither a fetch nor a lookup."""
    return ~((state == "in_progress") | looking)


def eviction_victims(entries: DataFrame, capacity: int) -> DataFrame:
    """I8: one eviction pass over a snapshot (key, seq, seen_count, last_seen, has_metadata, peers, evictable).

    First entries seen once without peers and metadata, oldest first; if these are too few, the least valuable of the rest.
    """
    wanted = max(1, capacity // EVICTION_SHARE)
    loose = entries.where(F.col("evictable"))
    cheap = ~F.col("has_metadata") & (F.col("seen_count") <= 1) & (F.col("peers") == 0)
    first = loose.where(cheap).orderBy("seq").limit(wanted).select("key", F.lit(1).alias("phase"), F.col("seq").alias("_rank"), *[F.lit(0).cast("double").alias(c) for c in ("_m", "_p", "_s", "_l")])
    value = [F.col("has_metadata").cast("double").alias("_m"), (F.col("peers") > 0).cast("double").alias("_p"), F.col("seen_count").cast("double").alias("_s"), F.col("last_seen").alias("_l")]
    rest = loose.join(first.select("key"), "key", "left_anti").select("key", F.lit(2).alias("phase"), F.col("seq").alias("_rank"), *value)
    rest = rest.orderBy("_m", "_p", "_s", "_l", "_rank").limit(wanted)
    return first.unionByName(rest).orderBy("phase", "_m", "_p", "_s", "_l", "_rank").limit(wanted).select("key", "phase")


def start_budget(fetchable: Column, slots: Column, tokens: Column, target: int = 512) -> Column:
    """How many lookups may start."""
    return F.greatest(F.lit(0), F.least(F.lit(target) - fetchable, slots, tokens))


def reachable(peers: DataFrame, marks: DataFrame, now: float) -> DataFrame:
    """Peers (ip, port) without a mark that still holds, on the address or on the whole host (port null)."""
    live = marks.groupBy("ip", "port").agg(F.max("expiry").alias("expiry")).where(F.col("expiry") > now)
    hosts = live.where(F.col("port").isNull()).select("ip")
    return peers.join(hosts, "ip", "left_anti").join(live.where(F.col("port").isNotNull()).select("ip", "port"), ["ip", "port"], "left_anti")


def sample_backoff(now: Column, interval: Column, error: Column, most: int = 21600) -> Column:
    """When an address may be asked again; error 204 waits longest, no interval waits not at all."""
    wait = F.when(error == 204, F.lit(most)).otherwise(F.greatest(F.lit(0), F.least(F.coalesce(interval, F.lit(0)), F.lit(most))))
    return now + wait


def next_time(now: Column, lookups: Column) -> Column:
    """Waits grow with the number of lookups."""
    return now + F.lit(RETRY_SECONDS) * lookups
