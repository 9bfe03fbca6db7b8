"""Fetches over recorded outcomes (I15, I17, F11, B15): which transport of a peer answers, and which peers of a key are tried.

What each transport of a peer gave, and after how long, is recorded; the rules then say what an attempt by them comes to (column
expressions) and which attempts a key makes (a fold over its peers, at most 32).
"""

from __future__ import annotations

import heapq
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.stateful import fold

# Connections at once, peers of a key at once, seconds between their starts, reasons no peer is blamed for.
CONNECTIONS, PARALLEL, STAGGER = 256, 3, 0.3
UNBLAMED = ("local_error", "stopped")


def attempt(ip: Column, tcp: Column, encrypted: Column, utp: Column, utp_free: Column) -> dict[str, Column]:
    """Route, outcome and seconds of an attempt; tcp, encrypted and utp are (outcome, seconds) of each transport.

    A connection closed on the handshake is tried again encrypted. A refused connect (IPv4 only, while slots are free) is tried
    over uTP; if that can't connect either, the TCP reason stays.
    """
    retried = tcp["outcome"] == "closed_on_handshake"
    first = F.when(retried & encrypted["outcome"].isNotNull(), encrypted["outcome"]).otherwise(tcp["outcome"])
    spent = tcp["seconds"] + F.when(retried, F.coalesce(encrypted["seconds"], F.lit(0.0))).otherwise(0.0)
    other = (first == "connect") & utp_free & ~F.contains(ip, F.lit(":")) & utp["outcome"].isNotNull()
    told = other & (utp["outcome"] != "connect_timeout")
    outcome = F.when(told & (utp["outcome"] == "ok"), "ok").when(told, F.concat(F.lit("utp_"), utp["outcome"])).otherwise(first)
    route = F.when(told, "utp").when(retried & encrypted["outcome"].isNotNull(), "encrypted").otherwise("tcp")
    return {"route": route, "outcome": outcome, "seconds": spent + F.when(other, utp["seconds"]).otherwise(0.0)}


class Job:
    """A key's attempts, newest peer first: up to `parallel` at once, the next one after `stagger` seconds or when one ends; the
    first success ends the job, and what still runs is let go."""

    def __init__(self, parallel: int = PARALLEL, stagger: float = STAGGER) -> None:
        self.parallel, self.stagger = parallel, stagger
        self.now, self.running, self.blamed, self.reason, self.tried, self.route, self.last = 0.0, [], [], "stopped", 0, None, None

    def end_one(self) -> None:
        """Lets time pass up to the end of the attempt that ends first."""
        moment, _, peer, outcome, route = heapq.heappop(self.running)
        self.now = max(self.now, moment)
        if outcome == "ok":
            self.reason, self.route = "ok", route
        else:
            self.reason = outcome
            if outcome not in UNBLAMED:
                self.blamed.append(peer)

    def offer(self, peer: Any, outcome: str, route: str, seconds: float, unreachable: bool) -> None:
        """The next peer's turn."""
        if self.route:
            return
        due = self.now if self.last is None else self.last + self.stagger
        while self.running and not self.route and (len(self.running) >= self.parallel or self.running[0][0] <= due):
            self.end_one()
            due = self.now
        if self.route:
            return
        if unreachable:
            self.blamed.append(peer)
            self.reason = "skipped_unreachable"
            return
        self.now = max(self.now, due if self.running else self.now)
        self.last, self.tried = self.now, self.tried + 1
        heapq.heappush(self.running, (self.now + seconds, self.tried, peer, outcome, route))

    def close(self) -> tuple[str, str | None, float, int, str]:
        """(outcome, route, seconds, attempts, blamed peers) once all turns are over."""
        while self.running and not self.route:
            self.end_one()
        return self.reason, self.route, self.now, self.tried, ",".join(map(str, self.blamed if not self.route else ()))


RESULT = "key long, outcome string, route string, seconds double, attempts int, blamed string"


def jobs(attempts: DataFrame, parallel: int = PARALLEL, stagger: float = STAGGER) -> DataFrame:
    """What the attempts (key, touched, peer, outcome, route, seconds, unreachable) of each key come to. Peers to blame are
    listed only where the job failed; a job without any is let go, not failed."""
    order = attempts.withColumn("turn", -F.col("touched"))
    rows = order.select("key", "turn", "peer", "outcome", "route", "seconds", "unreachable")

    def step(state: list, row: Any) -> tuple:
        state.append((row.peer, row.outcome, row.route, row.seconds, bool(row.unreachable)))
        job = Job(parallel, stagger)
        return state, (row.key, *_run(job, state))

    return fold(rows, "key", ["turn"], list, step, RESULT, every=False)


def _run(job: Job, turns: list[tuple]) -> tuple:
    for turn in turns:
        job.offer(*turn)
    return job.close()


def claims(entries: DataFrame, active: int, connections: int = CONNECTIONS) -> DataFrame:
    """The entries that get a free connection, those seen most first."""
    return entries.where(F.col("queue") == "fetchable").orderBy(F.desc("seen_count"), F.desc("last_seen"), "key").limit(max(0, connections - active))


def newest_first(peers: Column) -> Column:
    """a key's peers in the order they are tried."""
    return F.reverse(peers)
