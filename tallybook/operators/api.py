"""Answers as a program asks for them (A13, A24, A29, A30, H14): search, details and statistics, each a status and a record.

A page of rows at most reaches the driver. Without a store, the live catalog is searched; with one, the store is.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import address, display
from tallybook.operators import search, store

T = TypeVar("T")
#: What errors say.
MESSAGES = {400: "invalid info hash", 404: "not found", 503: "search database unavailable"}
RETRY_SECONDS = 0.1
log = logging.getLogger(__name__)


def read_with_retry(read: Callable[[], T], pause: float = RETRY_SECONDS, tries: int = 2) -> tuple[bool, T | None]:
    """(whether it was read, what); a failed read is tried once more after a pause."""
    for left in reversed(range(tries)):
        try:
            return True, read()
        except PySparkException as e:
            if left:
                time.sleep(pause)
            else:
                log.warning("store unavailable: %s", e)
    return False, None


def error(status: int) -> tuple[int, dict[str, Any]]:
    """A30"""
    return status, {"error": MESSAGES[status]}


def _records(rows: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in rows.collect()]


def with_magnet(rows: DataFrame, name: str = "name") -> DataFrame:
    """Records with their link."""
    return rows.withColumn("magnet", display.magnet_link(F.col("info_hash"), F.col(name)))


@dataclass
class Stored:
    """What searches and details read of a store: documents with counters, postings and typos."""

    documents: DataFrame
    postings: DataFrame
    typos: DataFrame


@dataclass
class Api:
    """`live` has the catalog's records (see store.live_detail) and, for searches without a store, paths; `stored` opens the store,
    and is called again for every read, so that a read that failed may succeed next time."""

    live: DataFrame
    statistics: Callable[[], dict[str, Any]]
    stored: Callable[[], Stored] | None = None

    def answer(self, path: str, params: dict[str, str] | None = None) -> tuple[int, dict[str, Any]]:
        """The answer to a request by its path."""
        if path == "/api/stats":
            return self.stats()
        if path == "/api/search":
            return self.search(params or {})
        prefix, _, key = path.rpartition("/")
        return self.detail(key) if prefix == "/api/torrent" else error(404)

    def stats(self) -> tuple[int, dict[str, Any]]:
        return 200, self.statistics()

    def search(self, params: dict[str, str]) -> tuple[int, dict[str, Any]]:
        asked = address.parse_search(params)
        query, limit, sort, desc = asked["query"], asked["limit"], asked["sort"], asked["order"] == "desc"
        if self.stored is None:
            engine, good, rows = "memory", True, _records(with_magnet(search.scan_memory(self.live.where("metadata is not null").select("info_hash", *store.COUNTERS, "metadata.*", "paths"), query, limit, sort, desc)))
        else:

            def read() -> list[dict[str, Any]]:
                s = self.stored()
                return _records(with_magnet(search.search(s.documents, s.postings, s.typos, query, limit, sort, desc)))

            engine = "sqlite"
            good, rows = read_with_retry(read)
        if not good:
            return error(503)
        return 200, {"query": query, "limit": limit, "count": len(rows), "engine": engine, "sort": sort, "order": asked["order"], "results": rows}

    def detail(self, key: str) -> tuple[int, dict[str, Any]]:
        """The live record if it has metadata, else the stored one, else the live one."""
        info_hash = address.parse_hash(key)
        if info_hash is None:
            return error(400)
        found = _records(store.document(self.live, info_hash).limit(1))
        record, good = (found[0] if found else None), True
        if (record is None or record["metadata"] is None) and self.stored is not None:
            good, rows = read_with_retry(lambda: _records(store.stored_detail(store.document(self.stored().documents, info_hash)).limit(1)))
            record = rows[0] if rows else record
        if record is None:
            return error(404 if good else 503)
        record.pop("paths", None)
        name = (record["metadata"] or {}).get("name") or ""
        link = self.live.sparkSession.range(1).select(display.magnet_link(F.lit(info_hash), F.lit(name)).alias("m")).first().m
        return 200, record | {"magnet": link}


def encoded(answer: tuple[int, dict[str, Any]]) -> tuple[int, str]:
    """An answer as compact ASCII JSON."""
    return answer[0], json.dumps(answer[1], ensure_ascii=True, separators=(",", ":"))
