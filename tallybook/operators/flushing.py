"""Flushing to the store (I9, I10, I11, I16, E3, E5, F7, D15): what is due, what a failure changes, what goes back to a queue."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.stateful import fold

# Seconds between works, first and longest wait after failures, seconds of failing checks until they are switched
# off, sizes of batches, batches of checks at a time, seconds of the last flush, most documents that wait.
EVERY = {"checks": 0.25, "documents": 1.0, "counters": 30.0, "totals": 10.0}
WAIT_FIRST, WAIT_MOST, FAIL_OPEN = 1.0, 30.0, 60.0
BATCH, CHECK_BATCH, CHECK_BATCHES, LAST_FLUSH, MOST_WAITING = 250, 500, 20, 3.0, 100_000


class Schedule:
    """Works in their order, each when it is due. A failure ends the turn, and the next one waits, twice as long each time;
    a turn without one ends the waiting. Checks that fail for FAIL_OPEN seconds are switched off until one succeeds."""

    def __init__(self, start: float) -> None:
        self.due = {work: start + (seconds if work in ("counters", "totals") else 0.0) for work, seconds in EVERY.items()}
        self.wake, self.wait, self.errors, self.failing, self.open = start, 0.0, 0, None, False

    def turn(self, now: float, good: dict[str, bool]) -> list[str]:
        """The works done at this moment; good says which of them would succeed."""
        if now < self.wake:
            return []
        done = []
        for work in [w for w, at in self.due.items() if now >= at]:
            if work == "checks":
                self.check(now, good[work])
            if not good[work]:
                self.errors += 1
                self.wait = min(2 * self.wait, WAIT_MOST) if self.wait else WAIT_FIRST
                self.wake = now + self.wait
                return done
            self.due[work] = now + EVERY[work]
            done.append(work)
        self.wait, self.wake = 0.0, min(self.due.values())
        return done

    def check(self, now: float, good: bool) -> None:
        if good:
            self.failing, self.open = None, False
        elif self.failing is None:
            self.failing = now
        elif now - self.failing >= FAIL_OPEN:
            self.open = True


TURNS = "scope long, seq long, done string, waits double, wake double, errors int, unchecked boolean"


def turns(ticks: DataFrame) -> DataFrame:
    """What each tick (scope, seq, moment, and for each work whether it would succeed) does: works done, the wait and
    when it is over, errors so far, whether checks are switched off."""

    def step(state: Schedule | None, row: Any) -> tuple:
        s = state or Schedule(row.moment)
        done = s.turn(row.moment, {w: getattr(row, w) for w in EVERY})
        return s, (row.scope, row.seq, ",".join(done), s.wait, s.wake, s.errors, s.open)

    return fold(ticks, "scope", ["moment", "seq"], lambda: None, step, TURNS)


def drain_documents(queue: DataFrame, limit: int = BATCH) -> DataFrame:
    """the documents that wait longest."""
    return queue.orderBy("seq").limit(limit)


def drain_counters(queue: DataFrame, limit: int = BATCH) -> DataFrame:
    """Counters that have gained something: those of evicted entries (orphans) first, then the longest waiting. Entries that
    were never written go the documents' way and are not taken here."""
    some = (F.col("seen_delta") > 0) | (F.col("announce_delta") > 0)
    return queue.where(some & (F.col("orphan") | F.col("in_store"))).orderBy(F.desc("orphan"), "seq").limit(limit)


def requeued(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """The queue with a failed batch in front again. Rows keep their numbers, so the order is as before; a key that was queued
    meanwhile stands there once, with the older place."""
    both = queue.unionByName(batch)
    values = [c for c in queue.columns if c not in ("key", "seq")]
    return both.groupBy("key").agg(F.min("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in values]).select(queue.columns)


def flushed(entries: DataFrame, batch: DataFrame, good: bool) -> DataFrame:
    """Entries (key, seen_count, announce_count, flushed_seen, flushed_announce) after a batch of snapshots (key, seen_count,
    announce_count): what a successful write has taken counts as flushed, a failed one changes nothing."""
    if not good:
        return entries
    b = batch.select("key", F.col("seen_count").alias("_s"), F.col("announce_count").alias("_a"))
    joined = entries.join(b, "key", "left")
    return joined.withColumns({"flushed_seen": F.coalesce("_s", "flushed_seen"), "flushed_announce": F.coalesce("_a", "flushed_announce")}).select(entries.columns)


def orphans(entries: DataFrame, victims: DataFrame, most: int = MOST_WAITING) -> DataFrame:
    """Evicted entries whose last sightings aren't written yet; the newest `most` of them are kept."""
    gone = entries.join(victims.select("key"), "key", "left_semi").where("seen_count > flushed_seen or announce_count > flushed_announce")
    return gone.select("key", "seq", (F.col("seen_count") - F.col("flushed_seen")).alias("seen_delta"), (F.col("announce_count") - F.col("flushed_announce")).alias("announce_delta"), "last_seen").orderBy(F.desc("seq")).limit(most)


def reset_missing(entries: DataFrame, missing: DataFrame) -> DataFrame:
    """E5: entries that the store has no row for are to be written in full again: as a document if their metadata is held, else the
    key is fetched again (done becomes pending)."""
    lost = entries.join(missing.select("key", F.lit(True).alias("_lost")), "key", "left")
    again = F.coalesce("_lost", F.lit(False))
    state = F.when(again & ~F.col("has_metadata") & F.col("in_store") & (F.col("fetch_state") == "done"), "pending").otherwise(F.col("fetch_state"))
    queued = again & F.col("has_metadata")
    zero = lambda c: F.when(again, 0).otherwise(F.col(c))
    return lost.withColumns({"flushed_seen": zero("flushed_seen"), "flushed_announce": zero("flushed_announce"), "fetch_state": state, "document_queued": queued, "in_store": F.col("in_store") & ~again}).drop("_lost")


def bounded(queue: DataFrame, most: int = MOST_WAITING) -> DataFrame:
    """The queue (key, seq) with a column dropped: true for the oldest beyond `most`. Their documents are pending again; a sum of
    the column is the count of the dropped. One pass over numbered rows, no sort of the whole queue by one task."""
    kept = queue.orderBy(F.desc("seq")).limit(most).agg(F.min("seq").alias("_first"))
    return queue.crossJoin(F.broadcast(kept)).withColumn("dropped", F.col("seq") < F.col("_first")).drop("_first")


def last_flush(batches: DataFrame, seconds: float = LAST_FLUSH) -> DataFrame:
    """I16: of batches (kind, seq, seconds) those written on a stop: documents, then counters, while the time isn't over."""
    order = Window.orderBy(F.when(F.col("kind") == "documents", 0).otherwise(1), "seq").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("begins", F.coalesce(F.sum("seconds").over(order), F.lit(0.0))).where(F.col("begins") < seconds)


def error_count(progress: Column) -> Column:
    """Errors of a list of turns (true: failed)."""
    return F.size(F.filter(progress, lambda failed: failed))
