"""Sequential folds over ordered events (I2-I5, I17-I19, D12, D13): limits, token bucket, state machines.

A fold reads its keys' rows in order from sorted partitions and keeps one state per key, so memory does not follow the key's
rows. The same step functions run in the streaming operators.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import codecs
from tallybook.operators.catalog import MAX_ATTEMPTS, MAX_LOOKUPS, MAX_PEERS

# Packets per address and window, its length; pieces asked for at a time, packets kept out of order; queries per
# second; when a lookup has enough.
WINDOW_PACKETS, WINDOW_SECONDS = 40, 10.0
PIECE_WINDOW, OUT_OF_ORDER = 8, 1024
BUCKET_RATE = 420.0
ENOUGH_PEERS, ENOUGH_REPLIES, MOST_QUERIES, LOOKUP_SECONDS = 8, 2, 16, 6.0


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], out: str, every: bool = True) -> DataFrame:
    """Folds each key's rows in order. step(state, row) returns (state, output tuple); with every=False only the last output
    of a key is kept. out: schema of the outputs, whose first column is the key. Rows without a key are one key."""
    fields = [c.split() for c in out.split(",")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    row_of = namedtuple("Row", rows.columns)

    def table(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = object(), None, None
        for b in batches:
            made = []
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = row_of._make(values)
                k = getattr(row, key)
                if k != now:
                    if last is not None and not every:
                        made.append(last)
                    now, state, last = k, start(), None
                state, last = step(state, row)
                if every:
                    made.append(last)
            if made:
                yield table(made)
        if last is not None and not every:
            yield table([last])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def rate_limited(packets: DataFrame, most: int = WINDOW_PACKETS, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Whether each packet (key, seq, moment) may be sent; a window starts with the first packet after the last one is
    over, and packets that are held back don't extend it.

    Whole windows are found by search in a key's moments, so the cost follows windows and not packets. A key is one task's.
    """

    def windows(moment: np.ndarray, opened: float | None, used: int) -> tuple[np.ndarray, float | None, int]:
        """Whether each packet of one key passes, and the window that is open at the end."""
        passes, at = np.zeros(len(moment), bool), 0
        while at < len(moment):
            if opened is None or moment[at] - opened >= seconds:
                opened, used = float(moment[at]), 0
            stop = at + int(np.searchsorted(moment[at:] - opened, seconds))
            free = max(0, min(stop - at, most - used))
            passes[at : at + free] = True
            used, at = used + free, stop
        return passes, opened, used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nulls are told from keys by a column of their own.
        now, opened, used = None, None, 0
        for b in batches:
            known, key, moment = (b.column(c).to_numpy(zero_copy_only=False) for c in ("known", "k", "moment"))
            edges = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (key[1:] != key[:-1]), True]) if len(key) else np.zeros(1, int)
            allowed = np.zeros(len(key), bool)
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if (known[i], key[i]) != now:
                    now, opened, used = (known[i], key[i]), None, 0
                allowed[i:j], opened, used = windows(moment[i:j], opened, used)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array(allowed)], ["key", "seq", "allowed"])

    rows = packets.select("key", F.col("key").isNotNull().alias("known"), F.coalesce("key", F.lit(0)).cast("long").alias("k"), "seq", F.col("moment").cast("double").alias("moment"))
    return rows.repartition("key").sortWithinPartitions("known", "k", "moment", "seq").mapInArrow(run, "key long, seq long, allowed boolean")


def token_bucket(requests: DataFrame, rate: float = BUCKET_RATE) -> DataFrame:
    """I4: whether each request of a scope finds a token; the bucket holds one second's worth and refills continuously. Requests
    of a scope depend on each other, so a scope is one task's; there are as many tasks as scopes."""

    def step(state: tuple[float, float] | None, row: Any) -> tuple:
        full, at = state or (rate, row.moment)
        full = min(rate, full + max(0.0, row.moment - at) * rate)
        allowed = full >= 1
        return (full - allowed, max(at, row.moment)), (row.key, row.seq, allowed)

    return fold(requests, "key", ["moment", "seq"], lambda: None, step, "key long, seq long, allowed boolean")


class Fetch:
    """State of one key: peers in order of their last touch, failed peers, attempts, lookups, whether a lookup runs."""

    def __init__(self, peers: list | None = None, failed: list | None = None, attempts: int = 0, lookups: int = 0, state: str = "pending", error: str = "", looking: bool = False) -> None:
        self.peers, self.failed, self.attempts, self.lookups, self.state, self.error, self.looking = dict.fromkeys(peers or []), set(failed or []), attempts, lookups, state, error, looking

    def add(self, peer: Any) -> None:
        if peer is not None and peer not in self.failed and self.state != "done":
            self.peers.pop(peer, None)
            self.peers[peer] = None
            if len(self.peers) > MAX_PEERS:
                del self.peers[next(iter(self.peers))]

    def apply(self, kind: str, peer: Any) -> None:
        """kind: peer (one was seen); claim and release of a fetch; look and unlook (a lookup starts, or is let go); lookup (one
        has ended, with a peer or none); ok; or the reason a fetch failed for (with the peer that is to blame, else the newest)."""
        does = getattr(self, f"_{kind}", None)
        if does:
            does(peer)
        else:
            self._fail(kind, peer)

    _peer = add

    def _claim(self, _: Any) -> None:
        if self.state == "pending" and self.peers:
            self.state = "in_progress"

    def _release(self, _: Any) -> None:
        if self.state == "in_progress":
            self.state = "pending"

    def _look(self, _: Any) -> None:
        self.looking = self.looking or (self.state == "pending" and not self.peers and self.lookups < MAX_LOOKUPS)

    def _unlook(self, _: Any) -> None:
        self.looking = False

    def _lookup(self, peer: Any) -> None:
        self.looking = False
        self.lookups += 1
        self.add(peer)
        if not self.peers and self.lookups >= MAX_LOOKUPS and self.state == "pending":
            self.state, self.error = "failed", "no_peers"

    def _ok(self, _: Any) -> None:
        self.state, self.error = "done", ""

    def _fail(self, reason: str, peer: Any) -> None:
        if self.state not in ("pending", "in_progress") or not self.peers:
            return
        tried = peer if peer is not None else next(reversed(self.peers))
        self.peers.pop(tried, None)
        self.failed.add(tried)
        self.attempts += 1
        spent = not self.peers and self.lookups >= MAX_LOOKUPS and not self.looking
        over = self.attempts >= MAX_ATTEMPTS
        self.error = "no_peers" if spent and not over else reason
        self.state = "failed" if over or spent else "pending"

    def stored(self) -> list:
        """What makes the same state again."""
        return [list(self.peers), sorted(self.failed), self.attempts, self.lookups, self.state, self.error, self.looking]

    def row(self, key: Any) -> tuple:
        return key, self.state, self.attempts, self.lookups, len(self.peers), self.error


FETCH = "key long, state string, attempts int, lookups int, peers int, error string"


def fetch_states(steps: DataFrame) -> DataFrame:
    """Where each key's steps (key, seq, kind, peer) lead."""

    def step(state: Fetch, row: Any) -> tuple:
        state.apply(row.kind, row.peer)
        return state, state.row(row.key)

    return fold(steps, "key", ["seq"], Fetch, step, FETCH, every=False)


def lookup_outcomes(replies: DataFrame) -> DataFrame:
    """Per lookup (key, seq, moment, peer or null) when and why it ends: enough peers, enough replies with peers, too
    many queries, too late, or no more replies."""

    def step(state: dict | None, row: Any) -> tuple:
        s = state or {"start": row.moment, "peers": set(), "values": 0, "n": 0, "why": "exhausted"}
        if s["why"] == "exhausted":
            s["n"] += 1
            late = row.moment - s["start"] >= LOOKUP_SECONDS
            if row.peer is not None and not late:
                s["peers"].add(row.peer)
                s["values"] += 1
            for why, over in (("deadline", late), ("peers", len(s["peers"]) >= ENOUGH_PEERS), ("replies", s["values"] >= ENOUGH_REPLIES), ("queries", s["n"] >= MOST_QUERIES)):
                if over and s["why"] == "exhausted":
                    s["why"] = why
        return s, (row.key, s["why"], s["n"], len(s["peers"]))

    return fold(replies, "key", ["moment", "seq"], lambda: None, step, "key long, reason string, queries int, peers int", every=False)


def in_flight(rows: DataFrame, scope: str = "key", order: str = "seq") -> DataFrame:
    """How many requests of a scope are open after each event (delta +1 or -1)."""
    return rows.withColumn("open", F.sum("delta").over(Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def high_water(rows: DataFrame, value: str, scope: str = "key", order: str = "seq") -> DataFrame:
    """The most a gauge has shown so far."""
    return rows.withColumn("most", F.max(value).over(Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_success(attempts: DataFrame) -> DataFrame:
    """Per key the transport that succeeded first, else the reason of the first attempt that failed with more than a refusal
    to connect, else of the first; attempts have (key, seq, transport, outcome)."""
    ok, refused = F.col("outcome") == "ok", F.col("outcome").isin("connect", "connect_timeout")
    told = F.coalesce(F.max(F.when(ok, F.lit("ok"))), F.min_by(F.when(~refused, F.col("outcome")), F.when(~refused, F.col("seq"))), F.min_by("outcome", "seq"))
    return attempts.groupBy("key").agg(F.min_by(F.when(ok, F.col("transport")), F.when(ok, F.col("seq"))).alias("transport"), told.alias("outcome"))


def reassembled(pieces: DataFrame) -> DataFrame:
    """Per key its pieces (key, piece, data, size) joined in order, or null while some are missing; later copies count
    nothing, and pieces beyond the size or of another length than their place asks for are left out. A hash has few pieces by
    definition, so a group is small."""
    fits = F.col("piece").between(0, codecs.piece_count(F.col("size")) - 1) & (F.octet_length("data") == codecs.piece_length(F.col("size"), F.col("piece")))
    one = pieces.where(fits).groupBy("key", "piece").agg(F.first("data").alias("data"), F.max("size").alias("size"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("piece", "data"))), F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    whole = one.groupBy("key").agg(joined.alias("raw"), F.max("size").alias("size"))
    return whole.select("key", F.when(F.octet_length("raw") == F.col("size"), F.col("raw")).alias("raw"))


def piece_sessions(messages: DataFrame, window: int = PIECE_WINDOW) -> DataFrame:
    """Per key how a session over its received messages (key, seq, kind, piece, length, total, size) ends: done, reject,
    bad_piece, or open while pieces are missing; with how many pieces came in and how many messages were passed over.

    Up to `window` pieces are asked for at a time, the next one when one has come. Messages for pieces that aren't asked for
    and those of other kinds are passed over; a piece of a wrong length or total ends the session, as a reject does.
    """

    def step(state: dict | None, row: Any) -> tuple:
        s = state or {"end": "open", "asked": set(range(min(window, -(-row.size // codecs.PIECE)))), "next": window, "got": 0, "passed": 0}
        count = -(-row.size // codecs.PIECE)
        if s["end"] == "open":
            if row.piece not in s["asked"] or row.kind not in ("data", "reject"):
                s["passed"] += 1
            elif row.kind == "reject":
                s["end"] = "reject"
            elif row.length != min(codecs.PIECE, row.size - row.piece * codecs.PIECE) or row.total not in (None, row.size):
                s["end"] = "bad_piece"
            else:
                s["asked"].discard(row.piece)
                s["got"] += 1
                if s["next"] < count:
                    s["asked"].add(s["next"])
                s["next"] += 1
                s["end"] = "done" if s["got"] == count else "open"
        return s, (row.key, s["end"], s["got"], s["passed"])

    return fold(messages, "key", ["seq"], lambda: None, step, "key long, outcome string, pieces int, passed int", every=False)


def delivered(packets: DataFrame, most: int = OUT_OF_ORDER) -> DataFrame:
    """What each packet (key, seq, number) of a stream lets through: how many packets are delivered in order with it, and the
    last number delivered. Numbers are 16-bit and wrap around; the first packet of a key sets the start. A packet ahead of the
    next is kept, up to `most` of them; copies and old ones are dropped."""

    def step(state: dict | None, row: Any) -> tuple:
        s = state or {"last": (row.number - 1) % 65536, "kept": set()}
        ahead, count = (row.number - s["last"]) % 65536, 0
        if ahead == 1:
            s["kept"].add(row.number)
            while (after := (s["last"] + 1) % 65536) in s["kept"]:
                s["kept"].discard(after)
                s["last"], count = after, count + 1
        elif 1 < ahead < 32768 and len(s["kept"]) < most:
            s["kept"].add(row.number)
        return s, (row.key, row.seq, count, s["last"], len(s["kept"]))

    return fold(packets, "key", ["seq"], lambda: None, step, "key long, seq long, delivered int, last int, waiting int")


def resends(sent: DataFrame, horizon: float, first: float = 1.0, most: int = 4) -> DataFrame:
    """When packets (key, number, moment, acked or null) are sent again: after `first` seconds, then doubling, `most` times,
    until they are acknowledged or the horizon; column given_up says that all were used and the last wait passed."""
    waits = F.array(*[F.lit(first * (2 ** (k + 1) - 1)) for k in range(most + 1)])
    until = F.least(F.coalesce("acked", F.lit(horizon)), F.lit(horizon))
    due = F.filter(F.transform(waits, lambda w: F.col("moment") + w), lambda t: t < until)
    return sent.select("key", "number", F.slice(due, 1, most).alias("again"), (F.size(due) > most).alias("given_up"))


def gaps(packets: DataFrame) -> DataFrame:
    """Runs of consecutive numbers per key; the first run is what can be delivered in order."""
    distinct = packets.select("key", "seq").distinct()
    run = F.col("seq") - F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return distinct.withColumn("run", run).groupBy("key", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("packets")).drop("run")
