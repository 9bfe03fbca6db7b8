"""Streaming forms (A1, A16, D7, E3, I1, I2): the same answers as the batch operators, incrementally.

Each runs over what is there (availableNow) unless given another trigger, keeps its progress in the shared folder, and
leaves its result as a table there. Results are written per batch, in folders named by the batch's number: a batch that runs
again overwrites its own, and readers take the latest of a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import catalog, store
from tallybook.operators.stateful import FETCH, Fetch
from tallybook.session import shared_dir
from tallybook.sources import tables

_STATE_SCHEMA = "value string"


def replay(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A1: recorded files (a folder of them, or one) as a stream, some of them a turn."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", at.getName()).parquet(path[: -len(at.getName()) - 1]) if single else reader.parquet(path)


def _run(stream: DataFrame, mode: str, each: Any, name: str, trigger: dict[str, Any] | None = None) -> str:
    """Runs a query to its end; `each` gets every batch, its number and the folder it may write to."""
    folder = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(lambda rows, n: each(rows, n, folder)).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return folder


def counters(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Sighting counters, kept by key in the state store; every batch writes the keys it changed."""
    live = catalog.counters(tables.sightings(replay(spark, path, files)))
    folder = _run(live, "update", lambda rows, n, f: rows.write.mode("overwrite").parquet(f"{f}/out/batch={n}"), "counters")
    return _latest(spark, folder)


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each key what the last batch that changed it has written."""
    done = spark.read.parquet(f"{folder}/out")
    values = [c for c in done.columns if c not in ("key", "batch")]
    return done.groupBy("key").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("key", "v.*")


def distinct_peers(spark: SparkSession, path: str, files: int = 1000, hours: int | None = None) -> DataFrame:
    """The first sighting of each peer of a key. State grows with distinct peers; with `hours`, peers not seen for so long are
    forgotten, which bounds it, and may be reported again."""
    peers = tables.sightings(replay(spark, path, files)).where(F.col("peer").isNotNull()).select("key", "peer", F.timestamp_seconds("moment").alias("at"))
    peers = peers.withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["key", "peer"]) if hours else peers.dropDuplicates(["key", "peer"])
    folder = _run(peers.select("key", "peer"), "append", lambda rows, n, f: rows.write.mode("overwrite").parquet(f"{f}/out/batch={n}"), "peers")
    return spark.read.parquet(f"{folder}/out").select("key", "peer")


def upserted(spark: SparkSession, path: str, documents: DataFrame, files: int = 1000) -> DataFrame:
    """Sightings merged into the stored documents; a batch that is sent again is recognised by its number. Every sighting
    whose key is a document counts."""
    changes = tables.sightings(replay(spark, path, files)).select("key", "seq", "source", "moment")

    def each(rows: DataFrame, n: int, folder: str) -> None:
        delta = catalog.counters(rows.withColumn("peer", F.lit(None).cast("long")))
        docs = documents.join(delta, F.col("doc_id") == F.col("key")).withColumn("seq", F.col("doc_id"))
        to = store.Store(spark, f"{folder}/store")
        to.open()
        to.apply(docs.select("info_hash", "seq", "name", "size", "file_count", *store.COUNTERS), n)

    folder = _run(changes, "append", each, "upserts")
    return store.Store(spark, f"{folder}/store").read()


def _fetch_step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    now = Fetch(*json.loads(state.get[0])) if state.exists else Fetch()
    for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        now.apply(row.kind, None if row.peer is None or row.peer != row.peer else int(row.peer))
    state.update((json.dumps(now.stored()),))
    yield pd.DataFrame([now.row(key[0])], columns=[c.split()[0] for c in FETCH.split(", ")])


def fetch_states(spark: SparkSession, path: str, steps: Any, files: int = 1000) -> DataFrame:
    """The fetch state machine; steps turns sightings into (key, seq, kind, peer). Each batch writes the keys it changed."""
    stream = steps(tables.sightings(replay(spark, path, files)))
    live = stream.groupBy("key").applyInPandasWithState(_fetch_step, FETCH, _STATE_SCHEMA, "update", "NoTimeout")
    folder = _run(live, "update", lambda rows, n, f: rows.write.mode("overwrite").parquet(f"{f}/out/batch={n}"), "states")
    return _latest(spark, folder)
