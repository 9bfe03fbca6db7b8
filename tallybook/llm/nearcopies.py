"""Near copies by shingle similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are of two kinds. SimHash prints of the shingles within 3 bits, by the pivot tables of op9. They can't prove 0.8: on
4000 documents of sf0.1 such texts differ in up to 11 bits. So texts that share one of BANDS bands of ROWS minima each are
candidates too; at 0.8 a pair shares none with a chance of (1 - 0.8^6)^48 = 5e-7.
Texts tied by candidates, directly or not, come together once, and there every pair not yet linked is verified by its sets.
Texts with equal sets are one node, so copies cost nothing. Sets hold 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import components, fresh, lookup_join, materialize, small_batches, space_words
from tallybook.llm.contain import shingle_hashes
from tallybook.llm.simhash import majority, near_pairs, whole_groups

BANDS, ROWS = 48, 6
#: Texts compared at once; more tied by candidates are compared as pairs of such parts.
PART = 1024
#: Share of equal minima under which a pair is not verified; at 0.8 ten standard deviations away.
UNLIKE = 0.55
_RNG = np.random.default_rng(20240601)
_ODD = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)
_BAND = _RNG.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, BANDS, np.uint64)


def all_shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Shingle hashes in order, repeats included; fewer words than width are one shingle, no words give none."""
    words = space_words(text)
    return shingle_hashes(words, max(1, min(width, len(words))))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(all_shingles(text, width))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set."""
    high, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(high), 1024):
        np.minimum(out, ((high[k : k + 1024, None] ^ _FLIP) * _ODD).min(0), out=out)
    return out


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of a set's bands; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    key = (minima(hashes).reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64) + _PLACE
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of a spanning forest over sets of a similarity of at least `least`."""
    sizes, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    marks = np.array([minima(s) for s in sets])
    out = []
    for i in range(1, len(sets)):
        ratio = np.minimum(sizes[:i], sizes[i]) / np.maximum(np.maximum(sizes[:i], sizes[i]), 1)
        near = np.flatnonzero((ratio >= least - 1e-9) & ((marks[:i] == marks[i]).mean(1) >= UNLIKE))
        for j in near.tolist():
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= least * (sizes[i] + sizes[j] - both) - 1e-9:
                    out.append((i, j))
                    label[label == label[i]] = label[j]
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """A number of a row's id and text; rows that agree in both are one row repeated."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(id_col).isNull(), F.col(text_col))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The row of each class of near copies that has the smallest id (no id counts as the largest, then by text); all columns stay.

    Rows are judged by their texts: rows of one id with unlike texts all stay. A repeated row is a copy of itself. Null texts are
    empty texts, and all texts without words are copies.
    """
    small_batches(docs.sparkSession)
    [key_] = fresh(docs, "_key")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            every = [all_shingles(t, width) for t in b["text"]]
            sets = [np.unique(h) for h in every]
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "s": np.array([set_key(s) for s in sets], np.int64), "fp": np.array([majority(h) for h in every], np.uint64).view(np.int64), "bands": [bands(s) for s in sets]})

    found = materialize(rows.mapInPandas(prints, "id long, key long, s long, fp long, bands array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    reps = materialize(found.groupBy("s").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s in whole_groups(batches):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            root = np.repeat(s[starts], np.diff(np.r_[starts, len(key)]))
            other = root != s
            yield pa.RecordBatch.from_arrays([pa.array(s[other]), pa.array(root[other])], ["a", "b"])

    keys = reps.select(F.explode("bands").alias("key"), "s").repartition("key").sortWithinPartitions("key")
    alike = materialize(reps.groupBy("fp").agg(F.min("s").alias("node")))
    same_print = reps.select("fp", "s").join(alike, "fp").where("s <> node").select(F.col("s").alias("a"), F.col("node").alias("b"))
    met = keys.mapInArrow(ties, "a long, b long").unionByName(near_pairs(alike)).unionByName(same_print)
    tied = materialize(components(met).withColumnRenamed("node", "s").withColumnRenamed("component", "tie"))
    sizes = materialize(tied.groupBy("tie").agg(F.count("*").alias("c")))
    members = lookup_join(tied, sizes.withColumn("parts", F.ceil(F.col("c") / PART).cast("int")), ["tie"], "c", tied.count(), "inner")
    members = members.join(reps.select("s", F.col("first.key").alias("key")), "s").join(rows.select("key", "text"), "key")
    own = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
    other = F.when(F.col("parts") > 1, F.expr("filter(sequence(0, parts - 1), p -> p <> own)")).otherwise(F.array(F.lit(0)))
    members = members.withColumn("own", own).withColumn("other", F.explode(other))
    group = F.xxhash64("tie", F.least("own", "other"), F.greatest("own", "other"))

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for s, t in zip(g["s"].tolist(), g["text"], strict=True):
            if s not in sets:
                sets[s] = shingles(t, width)
        names = list(sets)
        return pd.DataFrame([(names[i], names[j]) for i, j in linked(list(sets.values()), least)], columns=["a", "b"], dtype="int64")

    links = members.select(group.alias("g"), "s", "text").groupBy("g").applyInPandas(verify, "a long, b long")
    classes = components(links)
    best = reps.join(classes, F.col("s") == F.col("node"), "left").groupBy(F.coalesce("component", "s").alias("class")).agg(F.min("first").alias("first"))
    kept = docs.withColumn(key_, row_key(id_col, text_col)).join(best.select(F.col("first.key").alias(key_)), key_, "left_semi")
    [n_] = fresh(kept, "_n")
    once = Window.partitionBy(key_).orderBy(key_)
    return kept.withColumn(n_, F.row_number().over(once)).where(F.col(n_) == 1).select(*docs.columns)
