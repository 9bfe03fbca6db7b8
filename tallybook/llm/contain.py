"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size (powers of two of their distinct shingles). Each partition has one MinHash sketch length:
with n shingles in its largest item and at least a share `least` of them in a document, at most n - ceil(least * n) are
missing, so of the n - ceil(least * n) + 1 smallest hashes of an item at least one is in the document. Documents probe these
minima with every shingle they have, whatever their length, so no candidate is missed; candidates are then verified by
exact containment of the item's shingle set, as strings.

Items of up to PASS_BYTES of text are broadcast, and documents are read once and not shuffled. More items are joined: the
documents' hashes that pass a filter of fixed size meet the items' minima by key, and candidates meet their texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fresh, materialize, plain_words, small_batches

#: Bytes of item text that are broadcast; more are joined.
PASS_BYTES = 32_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FILTER_BITS = 20
#: Bits of the filter of a join, as a power of two.
_JOIN_BITS = 26


class _Hashes(dict):
    """Hashes of words, computed once; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A hash of every run of width words, in order."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += h[k : k + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingle_set(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def sketch_length(n: int, least: float) -> int:
    """Smallest hashes of an item of up to n shingles of which a document with a share `least` of them has one."""
    return n - ceil(least * n - 1e-9) + 1


class Sketches:
    """Minima of all items, by shingle width (under 5 only for items with fewer words)."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, least: float) -> None:
        self.least = least
        self.items: list[tuple[object, int, set[bytes]]] = []
        hashes: list[np.ndarray] = []
        for item_id, text in items:
            words = plain_words(text)
            if words:
                w = min(width, len(words))
                self.items.append((item_id, w, shingle_set(words, w)))
                hashes.append(np.unique(shingle_hashes(words, w)))
        largest: dict[int, int] = defaultdict(int)
        for _, _, s in self.items:
            p = len(s).bit_length()
            largest[p] = max(largest[p], len(s))
        sketch = {p: sketch_length(n, least) for p, n in largest.items()}
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, ((_, w, s), h) in enumerate(zip(self.items, hashes, strict=True)):
            for x in h[: sketch[len(s).bit_length()]].tolist():
                found[w][x].append(k)
        self.by_width = {}
        for w, owners in found.items():
            keys = np.array(sorted(owners), np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_width[w] = (dict(owners), seen, keys[-1])

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, its distinct shingles, how many the text has) of items that the text contains."""
        words = plain_words(text)
        out = []
        for w, (owners, seen, top) in self.by_width.items():
            h = shingle_hashes(words, w)
            h = h[h <= top]
            h = h[seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
            near = {k for x in h.tolist() if x in owners for k in owners[x]}
            if near:
                has = shingle_set(words, w)
                for k in near:
                    item_id, _, s = self.items[k]
                    n = len(s & has)
                    if n >= self.least * len(s) - 1e-9:
                        out.append((item_id, len(s), n))
        return out


def _small(items: DataFrame, pass_bytes: int) -> Broadcast | None:
    """Items as broadcast rows, if their texts are within pass_bytes."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > pass_bytes:
        return None
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.select("item_id", "text").collect()])


def _joined(docs: DataFrame, items: DataFrame, width: int, least: float) -> DataFrame:
    """(k, item_id, n_shingles, n_found) of texts (by their hash k) and the items they contain, by joins. Copies of a text are
    searched once."""
    spark = docs.sparkSession
    items = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))

    def minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["item"], b["text"], strict=True):
                words = plain_words(t)
                w = min(width, len(words))
                h = np.unique(shingle_hashes(words, w)) if words else ()
                out += [(i, w, x) for x in h[: sketch_length((1 << len(h).bit_length()) - 1, least)]]
            frame = pd.DataFrame(out, columns=["item", "w", "h"])
            yield frame.astype({"item": "int64", "w": "int32"}).assign(h=frame["h"].to_numpy(np.uint64).view(np.int64))

    sketch = materialize(items.select("item", "text").mapInPandas(minima, "item long, w int, h long"))
    place = F.shiftrightunsigned("h", 64 - _JOIN_BITS)
    words = sketch.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _JOIN_BITS}) & 63 as int))")).alias("bits")).collect()
    seen = np.zeros(1 << (_JOIN_BITS - 6), np.int64)
    for r in words:
        seen[r["at"]] = r["bits"]
    held = spark.sparkContext.broadcast((seen.view(np.uint64), sorted(r.w for r in sketch.select("w").distinct().collect())))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, widths = held.value
        for b in batches:
            for k, t in zip(b["k"], b["text"], strict=True):
                ws = plain_words(t)
                for w in widths:
                    h = np.unique(shingle_hashes(ws, w))
                    at = h >> np.uint64(64 - _JOIN_BITS)
                    h = h[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                    yield pd.DataFrame({"k": np.full(len(h), k, np.int64), "w": np.full(len(h), w, np.int32), "h": h.view(np.int64)})

    once = docs.groupBy("k").agg(F.first("text").alias("text"))
    near = once.mapInPandas(probes, "k long, w int, h long").join(sketch, ["w", "h"]).select("k", "item").distinct()
    wanted = near.join(items, "item").groupBy("k").agg(F.collect_list(F.struct("item_id", F.col("text").alias("t"))).alias("items"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text, some in zip(b["k"], b["text"], b["items"], strict=True):
                has: dict[int, set[bytes]] = {}
                words = plain_words(text)
                for x in some:
                    own = plain_words(x["t"])
                    w = min(width, len(own))
                    s = shingle_set(own, w)
                    if w not in has:
                        has[w] = shingle_set(words, w)
                    n = len(s & has[w])
                    if n >= least * len(s) - 1e-9:
                        out.append((k, x["item_id"], len(s), n))
            frame = pd.DataFrame(out, columns=["k", "item_id", "n_shingles", "n_found"])
            yield frame.astype({"k": "int64", "item_id": "Int64", "n_shingles": "int64", "n_found": "int64"})

    return materialize(once.join(wanted, "k").mapInPandas(verify, "k long, item_id long, n_shingles long, n_found long"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    least: float = 0.8,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every pair with at least `least` of the item's shingles in the document.

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased. Items of fewer than width words
    are one shingle. Null and empty items or documents match nothing; repeated rows give repeated pairs; null ids stay null.
    Items beyond pass_bytes of text are joined instead of broadcast.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col("text").alias("text"))
    held = _small(items, pass_bytes)
    if held is None:
        keyed = rows.withColumn("k", F.xxhash64("text"))
        return keyed.select("doc_id", "k").join(_joined(keyed, items, width, least), "k").select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches = Sketches(held.value, width, least)
        for b in batches:
            found = [(d, i, n, m, m / n) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, n, m in sketches.matches(t)]
            frame = pd.DataFrame(found, columns=["doc_id", "item_id", "n_shingles", "n_found", "containment"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "n_shingles": "int64", "n_found": "int64", "containment": "float64"})

    return rows.mapInPandas(run, "doc_id long, item_id long, n_shingles long, n_found long, containment double")


def clean(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, item_id: str = "item_id", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs whose text contains no item, by the same search; each row is judged by its own text, so a repeated row
    stays or goes every time. With items within pass_bytes nothing is shuffled."""
    small_batches(docs.sparkSession)
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col("text").alias("text"))
    held = _small(items, pass_bytes)
    if held is None:
        [k_] = fresh(docs, "_k")
        found = _joined(docs.select(F.xxhash64("text").alias("k"), "text"), items, width, least)
        return docs.withColumn(k_, F.xxhash64("text")).join(found.select(F.col("k").alias(k_)), k_, "left_anti").select(*docs.columns)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sketches = Sketches(held.value, width, least)
        for texts in batches:
            yield pd.Series([bool(sketches.matches(t)) for t in texts], dtype=bool)

    return docs.where(~F.pandas_udf(run, "boolean")(F.col("text")))


#: Both sides of the check: shingles by list slices, containment by a join on them.
ORACLE = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(string_split(translate(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS ws FROM w
), items AS (
  SELECT id AS item_id, least(5, len(ws)) AS width, list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS sh
  FROM words WHERE side = 'i' AND len(ws) > 0
), probes AS (
  SELECT item_id, width, len(sh) AS n_shingles, unnest(sh) AS s FROM items
), docs AS (
  SELECT DISTINCT id AS doc_id, k.width, unnest(list_distinct(list_transform(range(1, len(ws) - k.width + 2), lambda i: array_to_string(ws[i:i + k.width - 1], ' ')))) AS s
  FROM words, (SELECT DISTINCT width FROM items) k WHERE side = 'd'
)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*)::DOUBLE / n_shingles AS containment
FROM probes JOIN docs USING (s, width) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
