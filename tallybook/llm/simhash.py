"""SimHash near-duplicates by pivot distance tables.

Fingerprints have 64 bits, one per bit position of the shingles' XXH64 hashes: set where over half of the hashes have it set.
Two fingerprints that differ in at most `bits` positions differ by at most `bits` in their distance to any reference
fingerprint, so a pair whose distances to one of many references (the pivots) lie further apart is discarded unseen.

Pivot distances alone would need every pair to be looked at. So that the work is dealt out, candidates share two of five
bit blocks (with 3 differing bits at most, three blocks can differ, two stay equal: nothing is lost). In a group, rows are
sorted by their distance to the first pivot, only rows within `bits` of it are paired, the other pivots discard, and the
survivors are verified by their true distance. A group leaves a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import components, lookup_join, materialize, small_batches, space_words

#: Lengths of the five bit blocks, from the lowest bit.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a group compared at once; a larger group is compared as pairs of such parts.
PART = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; no words give 0, fewer words than width are one shingle."""
    words = space_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip((ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; none give 0."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def pivots(count: int = 16, seed: int = 20240601) -> np.ndarray:
    """Reference fingerprints; random ones lie near 32 bits from each other."""
    return np.random.default_rng(seed).integers(0, 2**64, count, np.uint64)


class Forest:
    """Labels of rows under links folded in piece by piece; a label is the smallest row linked so far."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def fold(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up


def linked_rows(key: np.ndarray, prints: np.ndarray, bits: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, smaller linked row) of a spanning forest over rows with equal key whose prints differ in at most bits."""
    far = np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((far[:, 0], key))
    key, prints, far = key[order], prints[order], far[order]
    forest, at, step = Forest(len(key)), np.arange(len(key)), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        to = at + step
        near = (key[to] == key[at]) & (far[to, 0] - far[at, 0] <= bits)
        at, to = at[near], to[near]
        i, j = at, to
        for p in range(1, len(refs)):
            close = np.abs(far[i, p] - far[j, p]) <= bits
            i, j = i[close], j[close]
            if not len(i):
                break
        true = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        held.append((i[true], j[true]))
        size += int(true.sum())
        if size > 1_000_000:
            forest.fold(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        forest.fold(*map(np.concatenate, zip(*held, strict=True)))
    child = np.flatnonzero(forest.label != np.arange(len(key)))
    return order[child], order[forest.label[child]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row; the long has the fingerprint's bits as they are, so it may be negative."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.array([fingerprint(t, width, seed) for t in b["text"]], np.uint64).view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, fp long")


def near_pairs(reps: DataFrame, bits: int = 3, refs: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b) between nodes of reps (fp long, node long) that connect all nodes whose fingerprints differ in at most bits."""
    if bits > 3:
        raise ValueError("five blocks prove nothing over 3 bits")
    refs = pivots() if refs is None else refs
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", starts[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1)) for k in range(len(BLOCKS))]
    keys = [F.shiftleft(F.shiftleft(F.lit(t).cast("long"), 13).bitwiseOR(block[i]), 13).bitwiseOR(block[j]) for t, (i, j) in enumerate(combinations(range(5), 2))]
    rows = reps.where("node is not null").select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    # Groups that are too large are split by their own size, whatever share of the rows they hold.
    parts = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > PART).select("key", "c", F.ceil(F.col("c") / PART).cast("int").alias("parts")))
    dealt = lookup_join(rows, parts, ["key"], "c", reps.count() * len(keys))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.when(F.coalesce("parts", F.lit(1)) > 1, F.expr("filter(sequence(0, parts - 1), p -> p <> own)")).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other))
    group = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, node in whole_groups(batches):
            child, root = linked_rows(key, fp.view(np.uint64), bits, refs)
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root])], ["a", "b"])

    return dealt.select(group.alias("group"), "fp", "node").repartition("group").sortWithinPartitions("group").mapInArrow(groups, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first column, cut only where it changes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
        size += b.num_rows
        if size >= least:
            cols = tuple(map(np.concatenate, zip(*held, strict=True)))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in cols)
            held, size = [tuple(c[cut:] for c in cols)], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """(id, fp, component) per row of docs: component is the smallest id reachable over links of at most bits differing bits.

    Equal fingerprints are one node, so copies cost nothing. Null or empty texts have fingerprint zero and link like any
    other. Rows that repeat an id are one document and unite what they link to. A null id belongs to its fingerprint's
    component and joins what that links to; the component is null where no row of it has an id.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width))
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    nodes = reps.select("fp", F.col("fp").alias("node"))
    # Rows of one id with several fingerprints tie these; only ids that stand there more than once are asked for.
    twice = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("id", "a")
    same = prints.join(twice, "id").select("a", F.col("fp").alias("b"))
    found = components(near_pairs(nodes, bits).unionByName(same))
    classes = materialize(reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "id", F.coalesce("component", "fp").alias("class")))
    least = materialize(classes.groupBy("class").agg(F.min("id").alias("component"), F.count("*").alias("c")))
    named = materialize(lookup_join(classes, least, ["class"], "c", classes.count()).select("fp", "n", "component"))
    return lookup_join(prints, named, ["fp"], "n", prints.count()).select("id", "fp", "component")
