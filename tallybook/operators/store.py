"""The document table as versions of Parquet files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: version of the layout; other versions are refused.
SCHEMA_VERSION = 1
MAX_LONG = 2**63 - 1
COUNTERS = ("seen_count", "announce_count", "first_seen", "last_seen")


def saturated(x: Column) -> Column:
    """A wide integer, cut to what a long holds."""
    return F.least(x, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")


def summed(changes: DataFrame, key: str = "info_hash") -> DataFrame:
    """One change per key before the merge: deltas added up, moments by least and greatest, the first document kept."""
    rest = [c for c in changes.columns if c not in (key, "seq", *COUNTERS)]
    return changes.groupBy(key).agg(
        *[F.min_by(c, "seq").alias(c) for c in rest],
        *[F.sum(c).alias(c) for c in COUNTERS[:2]],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def merged(stored: DataFrame, changes: DataFrame, key: str = "info_hash") -> DataFrame:
    """A new key is inserted with its deltas as counters; for a known one only counters and moments change."""
    own = [c for c in stored.columns if c != key]
    old, new = stored.select(key, F.struct(*own).alias("o")), changes.select(key, F.struct(*own).alias("n"))
    fields = {c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in own}
    for c in COUNTERS[:2]:
        fields[c] = F.coalesce(f"o.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))
    fields["first_seen"], fields["last_seen"] = F.least("o.first_seen", "n.first_seen"), F.greatest("o.last_seen", "n.last_seen")
    return old.join(new, key, "full").select(key, *[c.alias(n) for n, c in fields.items()])


def previous(stored: DataFrame, changes: DataFrame, key: str = "info_hash") -> DataFrame:
    """The counters that each change (in order of seq, if it has one) finds before it: the stored ones and those that earlier
    changes of the same batch have added; nulls for the first change of a new key."""
    if "seq" not in changes.columns:
        return changes.select(key).join(stored.select(key, "seen_count", "announce_count", "first_seen"), key, "left")
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    had = {c: F.sum(c).over(before) for c in COUNTERS[:2]} | {"first_seen": F.min("first_seen").over(before)}
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in COUNTERS[:3]])
    rows = changes.select(key, "seq", *[v.alias(c) for c, v in had.items()]).join(old, key, "left")
    none = F.col("_seen_count").isNull() & F.col("seen_count").isNull()
    total = lambda c: F.when(~none, F.coalesce(f"_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c)
    return rows.select(key, "seq", total("seen_count"), total("announce_count"), F.least("first_seen", "_first_seen").alias("first_seen"))


def updated(stored: DataFrame, deltas: DataFrame, key: str = "info_hash") -> DataFrame:
    """Counters and latest moment of known keys; first_seen stays, unknown keys are not inserted."""
    d = deltas.select(key, *[F.col(c).alias(f"_{c}") for c in ("seen_count", "announce_count", "last_seen")])
    add = lambda c: F.col(c) + F.coalesce(f"_{c}", F.lit(0))
    values = {"seen_count": add("seen_count"), "announce_count": add("announce_count"), "last_seen": F.greatest("last_seen", "_last_seen")}
    return stored.join(d, key, "left").select(*[values[c].alias(c) if c in values else F.col(c) for c in stored.columns])


def missing(stored: DataFrame, deltas: DataFrame, key: str = "info_hash") -> DataFrame:
    """Keys to send again because the table has no row for them."""
    return deltas.join(stored.select(key), key, "left_anti")


def pending(entries: DataFrame) -> DataFrame:
    """What a key has gained since it was last written; only tracked entries with a stored or new document count."""
    gained = lambda c: (F.col(c) - F.col(f"flushed_{c}")).alias(c)
    rows = entries.where(F.col("tracked") & (F.col("in_database") | F.col("has_metadata")))
    return rows.select("info_hash", gained("seen_count"), gained("announce_count"), "last_seen").where("seen_count > 0 or announce_count > 0")


def totals(docs: DataFrame) -> DataFrame:
    """Documents, their size as a double (a sum of longs may overflow) and the last id."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.col("size").cast("double")), F.lit(0.0)).alias("size"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def caught_up(old: DataFrame, docs: DataFrame) -> DataFrame:
    """Totals brought up to date with the rows behind their high-water mark."""
    fresh = docs.crossJoin(F.broadcast(old.select(F.col("last_id").alias("_mark")))).where(F.col("id") > F.col("_mark")).drop("_mark")
    both = old.unionByName(totals(fresh))
    return both.agg(F.sum("documents").alias("documents"), F.sum("size").alias("size"), F.max("last_id").alias("last_id"))


def document(docs: DataFrame, info_hash: str) -> DataFrame:
    """One document; the predicate reaches the scan."""
    return docs.where(F.col("info_hash") == info_hash)


def lookup(docs: DataFrame, keys: DataFrame, key: str = "info_hash") -> DataFrame:
    """Counters of many keys; unknown ones are left out."""
    return docs.join(keys.select(key).distinct(), key, "left_semi")


FILE, PEER = "struct<path:string,length:bigint>", "struct<ip:string,port:int>"
#: Fields of a detail record's metadata; those that a table lacks are null.
METADATA = {"name": "string", "size": "bigint", "piece_length": "bigint", "file_count": "bigint", "files": f"array<{FILE}>", "is_private": "boolean", "fetched_at": "double", "source_peer": PEER}


def _metadata(columns: list[str]) -> Column:
    have = lambda c, kind: (F.col(c) if c in columns else F.lit(None)).cast(kind).alias(c)
    return F.struct(*[have(c, kind) for c, kind in METADATA.items()])


def stored_detail(docs: DataFrame) -> DataFrame:
    """A stored document as a detail record: done, without peers and without the peer it came from."""
    own = _metadata([c for c in docs.columns if c != "source_peer"])
    return docs.select(
        "info_hash", *COUNTERS, F.lit("done").alias("fetch_state"), F.lit(0).alias("fetch_attempts"), F.lit("").alias("last_error"), F.lit(0).alias("lookups_started"),
        F.array().cast(f"array<{PEER}>").alias("peers"), own.alias("metadata"),
    )


def live_detail(entries: DataFrame) -> DataFrame:
    """Entries of the catalog (info_hash, counters, fetch_state, fetch_attempts, last_error, lookups_started, peers,
    has_metadata and the metadata's fields) as detail records; metadata is null where none is held."""
    return entries.select(
        "info_hash", *COUNTERS, "fetch_state", "fetch_attempts", "last_error", "lookups_started", F.coalesce("peers", F.array().cast(f"array<{PEER}>")).alias("peers"),
        F.when(F.col("has_metadata"), _metadata(entries.columns)).alias("metadata"),
    )


def detail(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each key the live record if it has metadata, else the stored one, else the live one; source says which."""
    cols = [c for c in live.columns if c != "info_hash"]
    a, b = live.select("info_hash", F.struct(*cols).alias("a")), stored.select("info_hash", F.struct(*cols).alias("b"))
    source = F.when(F.col("a.metadata").isNotNull(), "live").when(F.col("b").isNotNull(), "stored").otherwise("live")
    pick = F.when(source == "live", F.col("a")).otherwise(F.col("b"))
    return a.join(b, "info_hash", "full").select("info_hash", source.alias("source"), pick.alias("d")).select("info_hash", "source", "d.*")


#: Parts of a table by the hash of its key; a batch rewrites those it touches.
PARTS = 64


class Store:
    """A table as numbered versions in a folder any Hadoop file system holds. A version is there when its write has finished,
    so readers see the old one or the new one; a failed write leaves nothing that is read. A version's name holds the last
    batch in it, so a batch that is sent again changes nothing (exactly once).

    Rows are dealt to PARTS by the hash of their key. A batch writes the parts it touches; a version is the latest writing of each
    part, and a writing is deleted once `keep` later versions don't need it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def open(self) -> bool:
        """Creates the folder; refuses another layout. Returns whether it was new."""
        mark = self._path(f"{self.path}/layout.json")
        if self._fs.exists(mark):
            found = json.loads(self.spark.read.text(f"{self.path}/layout.json").first()[0])
            if found.get("version") != SCHEMA_VERSION:
                raise ValueError(f"{self.path} has layout {found}")
            return False
        out = self._fs.create(mark, True)
        out.write(bytearray(json.dumps({"version": SCHEMA_VERSION}).encode()))
        out.close()
        return True

    def versions(self) -> list[tuple[int, int, str]]:
        """(version, last batch, folder) of all finished versions."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        done = [n for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n[1:].split("-")[0]), int(n.split("-b")[1]), f"{self.path}/{n}") for n in done)

    def _parts(self, upto: int | None = None) -> dict[int, str]:
        """Where the latest writing of each part is, as of a version."""
        found: dict[int, str] = {}
        for n, _, folder in self.versions():
            if upto is None or n <= upto:
                for status in self._fs.listStatus(self._path(folder)):
                    name = status.getPath().getName()
                    if name.startswith("part="):
                        found[int(name[5:])] = f"{folder}/{name}"
        return found

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The current version, or an older one that is still kept; None before the first."""
        paths = sorted(self._parts(upto).values())
        return self.spark.read.parquet(*paths) if paths else None

    def last_batch(self) -> int:
        found = self.versions()
        return found[-1][1] if found else -1

    def write(self, rows: DataFrame, batch: int, keep: int = 2, key: str = "info_hash") -> None:
        """A new version in which the parts that have rows here are these rows."""
        found = self.versions()
        n = found[-1][0] + 1 if found else 0
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
        rows.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{n:08d}-b{batch}")
        # What the oldest version kept does not read is of no use to later ones either.
        needed = set(self._parts(n - keep + 1).values()) if n >= keep else None
        for k, _, folder in found if needed is not None else ():
            if k < n - keep + 1:
                for status in self._fs.listStatus(self._path(folder)):
                    name = status.getPath().getName()
                    if name.startswith("part=") and f"{folder}/{name}" not in needed:
                        self._fs.delete(status.getPath(), True)

    def apply(self, changes: DataFrame, batch: int, key: str = "info_hash") -> bool:
        """Merges one batch unless it has been; returns whether it did. Only parts with changes are read and written."""
        if batch <= self.last_batch():
            return False
        change, parts = summed(changes, key), self._parts()
        touched = [r[0] for r in change.select(F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).distinct().collect()]
        paths = [parts[p] for p in touched if p in parts]
        self.write(merged(self.spark.read.parquet(*paths), change, key) if paths else change, batch, key=key)
        return True

    def file_size(self) -> int:
        """Bytes of the current version; 0 before the first."""
        return sum(self._fs.getContentSummary(self._path(p)).getLength() for p in self._parts().values())


def api_json(rows: DataFrame) -> str:
    """Records as compact ASCII JSON, for answers of a page at most."""
    return json.dumps([json.loads(r) for r in rows.toJSON().collect()], ensure_ascii=True, separators=(",", ":"))
