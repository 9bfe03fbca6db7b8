"""Recorded datagrams as rows (A2-A4, A15, B18-B20, C10, H37): decode, route, and the sightings they hold."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tallybook.functions import codecs
from tallybook.functions.codecs import bdecode, bencode
from tallybook.functions.types import BINARY, LONG, STRING, struct

#: Queries that are answered, and what an unknown one is answered with.
METHODS = ("ping", "find_node", "get_peers", "announce_peer", "sample_infohashes")
UNKNOWN_METHOD = 204

DECODED = struct(
    kind=STRING, transaction=BINARY, method=STRING, node_id=BINARY, info_hash=BINARY, port=LONG, implied=LONG,
    nodes=BINARY, nodes6=BINARY, samples=BINARY, interval=LONG, peers=ArrayType(BINARY), error=LONG,
)


def read(payload: bytes) -> dict[str, Any] | None:
    """The fields of one message, or None if it is malformed or no dictionary. Numbers beyond a long count as missing."""
    try:
        m = bdecode(payload)
    except ValueError:
        return None
    if not isinstance(m, dict):
        return None
    raw = lambda v: v if isinstance(v, bytes) else None
    whole = lambda v: v if isinstance(v, int) and -(2**63) <= v < 2**63 else None
    body = next((m[k] for k in (b"a", b"r") if isinstance(m.get(k), dict)), {})
    err = m.get(b"e")
    return {
        "kind": (raw(m.get(b"y")) or b"").decode("latin-1"),
        "transaction": raw(m.get(b"t")),
        "method": (raw(m.get(b"q")) or b"").decode("latin-1") or None,
        "node_id": raw(body.get(b"id")),
        "info_hash": raw(body.get(b"info_hash")),
        "port": whole(body.get(b"port")),
        "implied": whole(body.get(b"implied_port")),
        "nodes": raw(body.get(b"nodes")),
        "nodes6": raw(body.get(b"nodes6")),
        "samples": raw(body.get(b"samples")),
        "interval": whole(body.get(b"interval")),
        "peers": [v for v in body.get(b"values", []) if isinstance(v, bytes)] if isinstance(body.get(b"values"), list) else [],
        "error": whole(err[0]) if isinstance(err, list) and err else None,
    }


@F.pandas_udf(DECODED)
def decoded(payloads: pd.Series) -> pd.DataFrame:
    names = DECODED.names
    found = pd.DataFrame([read(bytes(p)) or {} if p is not None else {} for p in payloads], columns=names)
    for c in ("port", "implied", "interval", "error"):
        found[c] = found[c].astype("Int64")
    return found.astype({c: object for c in names if c not in ("port", "implied", "interval", "error")}).where(found.notna(), None)


def messages(packets: DataFrame) -> DataFrame:
    """A2: packets (payload, ...) with their fields; malformed ones are dropped, so count packets before."""
    return packets.withColumn("m", decoded("payload")).where(F.col("m.kind").isin("q", "r", "e")).select(*[c for c in packets.columns if c != "payload"], "m.*")


def answers(found: DataFrame) -> DataFrame:
    """A3: what each query is answered with: its own method, or the error for unknown ones."""
    queries = found.where(F.col("kind") == "q")
    return queries.withColumn("answer", F.when(F.col("method").isin(*METHODS), F.col("method")).otherwise(F.lit(f"error {UNKNOWN_METHOD}")))


def nodes(found: DataFrame) -> DataFrame:
    """A row for each node of a reply; IPv4 nodes by built-in functions, IPv6 ones from their own field."""
    replies = found.where(F.col("kind") == "r")
    four = replies.select("seq", F.posexplode(codecs.cut(F.col("nodes"), codecs.NODE4)).alias("pos", "n"))
    six = replies.select("seq", F.posexplode(codecs.cut(F.col("nodes6"), codecs.NODE6)).alias("pos", "n"))
    row = lambda rows, ip, width: rows.select("seq", "pos", F.substring("n", 1, 20).alias("node_id"), ip(F.substring("n", 21, width)).alias("ip"), codecs.compact_port(F.substring("n", 21, width), width).alias("port"))
    return row(four, codecs.compact_ip4, codecs.ADDRESS4).unionByName(row(six, codecs.compact_ip6, codecs.ADDRESS6))


def samples(found: DataFrame) -> DataFrame:
    """A row for each sampled hash of a reply, with the node that gave it as hint."""
    return found.where(F.col("kind") == "r").select("seq", F.col("node_id").alias("hint"), F.explode(codecs.cut(F.col("samples"), codecs.ID_LENGTH)).alias("info_hash"))


def own_replies(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Replies that come from the address their transaction was sent to."""
    return found.join(asked.select("transaction", "ip", "port", "lookup"), ["transaction", "ip", "port"])


def query(method: str, transaction: bytes, **arguments: Any) -> bytes:
    """H37"""
    return bencode({"t": transaction, "y": "q", "q": method, "a": arguments})


def reply(transaction: bytes, **values: Any) -> bytes:
    """H37"""
    return bencode({"t": transaction, "y": "r", "r": values})


def error(transaction: bytes, code: int, text: str) -> bytes:
    """H37"""
    return bencode({"t": transaction, "y": "e", "e": [code, text]})


def summaries(raw: DataFrame) -> DataFrame:
    """Metadata that has the SHA-1 it should, summarised; others with the reason in error."""
    good = codecs.verified(F.col("raw"), F.col("info_hash"))
    found = raw.withColumn("_ok", good).withColumn("s", codecs.info_summaries("raw"))
    return found.select("info_hash", "s.name", "s.total_size", "s.piece_length", "s.file_count", "s.is_private", "s.files", F.when(~F.col("_ok"), "hash_mismatch").otherwise(F.col("s.error")).alias("error"))
