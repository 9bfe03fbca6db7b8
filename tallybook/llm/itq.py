"""Embedding near-duplicates by iterative quantisation.

Rotations of the principal components are learnt so that signs lose least (balanced binary codes). Codes of 128 bits are
retrieved by multi-index Hamming tables: each table is keyed by some of the bits, as many as the number of codes asks for, and
there are as many tables as it takes to bring a pair at the threshold together with a chance of 0.995. Only codes travel through
the tables. Of codes that meet, those within a Hamming radius are tied; a table leaves a spanning forest of its ties.

Vectors tied directly or over others come together once, and there every pair is reranked by the cosine of the original vectors
in double precision. So each link is counted once, and no pair is ever written out.

The tables miss some pairs: no key in common, a bucket that was split between them, more differing bits than the radius. An exact
check follows for pairs that have no tie. Vectors lie in cells by signs in the learnt directions, which are orthonormal: a pair
within a distance is within it in these directions too. So a vector is also compared in every cell that differs from its own only
in signs whose values, squared and added, stay within the squared distance of the threshold. No link can be lost that way.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallybook.llm.common import batch_rows, components, discard, lookup_join, materialize
from tallybook.llm.simhash import Forest, whole_groups

#: Documented bounds of the sample that rotations are learnt from: vectors, and numbers in them; every vector is indexed.
SAMPLE, SAMPLE_VALUES = 8192, 4_000_000
#: Bits of a code, in two words.
BITS = 128
#: Codes of a bucket compared at once; a larger bucket is split by further bits.
BUCKET = 4096
#: Vectors compared at once; more that are tied are compared as pairs of such parts.
PART = 2048
#: Length of the mean of unit vectors up to which it is taken away.
CENTRED = 0.2
#: Numbers in the vectors that lie in a cell; a larger cell is compared as pairs of parts of that size, with four times as many guests.
VALUES = 1_000_000
#: Comparisons up to which a cell isn't split any further.
SMALL = 250_000


def key_bits(codes: int) -> int:
    """Bits of a table's key: about one unrelated code a bucket."""
    return min(BITS, max(12, ceil(log2(max(codes, 1)))))


def tables(least: float, bits: int, missed: float = 0.005) -> int:
    """Tables it takes for a pair of a cosine of `least` to share a key of one of them."""
    alike = (1 - acos(least) / pi) ** bits
    return max(1, ceil(log(missed) / log(1 - alike))) if alike < 1 else 1


def radius(least: float) -> int:
    """Differing bits within which nearly all pairs of a cosine of `least` are: three deviations over the mean."""
    p = acos(least) / pi
    return ceil(BITS * p + 3 * sqrt(BITS * p * (1 - p)))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a power of two is taken out first, so that no square overflows or vanishes."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def room(least: float) -> float:
    """Squared distance of unit vectors with a cosine of `least`, and some more for what rounding may do."""
    return 2 - 2 * least + 1e-9


def bit_masks(count: int, bits: int, seed: int = 11) -> list[list[tuple[int, int]]]:
    """For each table its masks over a code's two words: of its key, then of ever longer ones, up to the whole code."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        order = rng.permutation(BITS)
        sizes = [*range(bits, BITS, 12), BITS]
        out.append([tuple(int(np.uint64(sum(1 << int(b) % 64 for b in order[:n] if b // 64 == w)).view(np.int64)) for w in (0, 1)) for n in sizes])
    return out


class Rotation:
    """Mean, principal directions and the learnt rotations of one dimension of vectors.

    Taking the mean away balances the codes, but it widens the angles of vectors near it: where the vectors lie close together,
    near copies would get unlike codes. So a mean longer than CENTRED stays in. Bits beyond the learnt ones are signs in random
    directions, all of them without a sample.
    """

    def __init__(self, dims: int, sample: np.ndarray | None = None, rounds: int = 40, seed: int = 3) -> None:
        self.mean, maps = np.zeros(dims), []
        if sample is not None:
            unit = units(sample)
            mean = unit.mean(0)
            self.mean = mean if np.linalg.norm(mean) <= CENTRED else self.mean
            centred = unit - self.mean
            _, _, axes = np.linalg.svd(centred, full_matrices=False)
            axes = axes[: BITS // 2]
            low = centred @ axes.T
            for k in range(2):
                turn, _ = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(len(axes), len(axes))))
                for _ in range(rounds):
                    u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
                    turn = (u @ v).T
                maps.append(axes.T @ turn)
        missing = BITS - sum(m.shape[1] for m in maps)
        #: Orthonormal directions, for cells.
        self.axes = maps[0] if maps else np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(dims, BITS // 2))))[0]
        self.map = np.hstack([*maps, np.random.default_rng(seed + 7).normal(size=(dims, missing))])

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Two unsigned words of each vector."""
        bits = (units(vectors) - self.mean) @ self.map >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Coordinates of unit vectors in the orthonormal directions."""
        return (unit - self.mean) @ self.axes


def rotation_of(learnt: dict[int, Rotation], dims: int) -> Rotation:
    """The rotation of a dimension, a random one where none was learnt."""
    if dims not in learnt:
        learnt[dims] = Rotation(dims)
    return learnt[dims]


def bucket_ties(key: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smaller row) of a spanning forest over rows with equal key, sorted by it, whose codes differ in at most `most` bits."""
    forest, at, step, held, size = Forest(len(key)), np.arange(len(key)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(one[at] ^ one[at + step]).astype(np.int16) + np.bitwise_count(two[at] ^ two[at + step]) <= most]
        held.append((near, near + step))
        size += len(near)
        if size > 1_000_000:
            forest.fold(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        forest.fold(*map(np.concatenate, zip(*held, strict=True)))
    child = np.flatnonzero(forest.label != np.arange(len(key)))
    return child, forest.label[child]


def group_links(key: np.ndarray, part: np.ndarray, cross: np.ndarray, vec: np.ndarray, times: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: rows with links, how many vectors these link to, and a linked smaller row. In a group of two parts
    (cross) only pairs across them count, as each part has a group of its own."""
    vec = units(vec)
    links, forest = np.zeros(len(key), np.int64), Forest(len(key))

    def fold(i: np.ndarray, j: np.ndarray) -> None:
        good = ~cross[i] | (part[i] != part[j])
        i, j = i[good], j[good]
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        forest.fold(i, j)

    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    start, size = edge[:-1], np.diff(edge)
    at, step = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        for k in range(0, len(at), 100_000):
            a = at[k : k + 100_000]
            near = a[np.einsum("ij,ij->i", vec[a], vec[a + step]) >= least]
            fold(near, near + step)
    for s, n in zip(start[size > 64], size[size > 64], strict=True):
        for k in range(0, n, 256):
            i, j = np.nonzero(np.triu(vec[s + k : min(s + k + 256, s + n)] @ vec[s + k : s + n].T >= least, 1))
            fold(i + s + k, j + s + k)
    found = np.flatnonzero(links)
    return found, links[found], forest.label[found]


def cells(place: np.ndarray, bits: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cell of each row by its first signs, and the higher cells that hold rows within `most`, squared."""
    row, cell, spent, home = np.arange(len(place)), np.zeros(len(place), np.int64), np.zeros(len(place)), np.ones(len(place), bool)
    for b in range(bits):
        value = place[row, b]
        sign = value >= 0
        # Of two cells the higher is where their rows meet, so the first sign that differs goes up.
        also = (spent + value * value <= most) & (~home | ~sign)
        cell = np.r_[2 * cell + sign, 2 * cell[also] + ~sign[also]]
        spent, home = np.r_[spent, (spent + value * value)[also]], np.r_[home, np.zeros(also.sum(), bool)]
        row = np.r_[row, row[also]]
    return row, cell, home


def alike(vec: np.ndarray, a: np.ndarray, b: np.ndarray, rough_a: np.ndarray, rough_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where rows a[i] and b[j] of vec have a cosine of at least `least`, by double precision.

    Single precision goes first: of unit vectors its error is under half of what is left open here.
    """
    maybe = np.flatnonzero(rough_a @ rough_b.T >= least - (vec.shape[1] + 8) * 2.0**-23)
    if len(maybe) * 16 > len(a) * len(b):
        maybe = np.flatnonzero(vec[a] @ vec[b].T >= least)
        return np.divmod(maybe, len(b))
    i, j = np.divmod(maybe, len(b))
    step = max(1, 1_000_000 // vec.shape[1])
    good = np.zeros(len(maybe), bool)
    for k in range(0, len(maybe), step):
        good[k : k + step] = np.einsum("ij,ij->i", vec[a[i[k : k + step]]], vec[b[j[k : k + step]]]) >= least
    return i[good], j[good]


def cell_links(vec: np.ndarray, place: np.ndarray, home: np.ndarray, inner: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a home row and a guest and, if inner, of two home rows, each pair once.

    While it saves comparisons the cell is split by the sign that saves most. Home rows go to their side; those of the lower side
    that are close enough are guests of the upper one. Guests go wherever they may meet a home row.
    """
    most, rough = room(least), vec.astype(np.float32)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home), np.zeros(len(home) - home.sum()), np.arange(place.shape[1]))]
    while todo:
        h, g, spent, bits = todo.pop()
        work = len(h) * (len(h) / 2 * inner + len(g))
        if work > SMALL and len(bits):
            # Which sign is best may be judged by some of the rows.
            a, b = -(-len(h) // 4096), -(-len(g) // 4096) or 1
            high, guest = place[np.ix_(h[::a], bits)], place[np.ix_(g[::b], bits)]
            over = (((high < 0) & (high * high <= most)).sum(0) * a) if inner else 0
            upper = (high >= 0).sum(0) * a
            lower = len(h[::a]) * a - upper
            swap = spent[::b, None] + guest * guest <= most
            cost = upper * (upper / 2 * inner + ((guest >= 0) | swap).sum(0) * b + over) + lower * (lower / 2 * inner + ((guest < 0) | swap).sum(0) * b)
            best = int(cost.argmin())
            if cost[best] < 0.8 * work:
                value, away = place[h, bits[best]], place[g, bits[best]]
                spend = spent + away * away
                rest = np.delete(bits, best)
                for up in (True, False):
                    own = (away >= 0) == up
                    stay = own | (spend <= most)
                    guests, costs = g[stay], np.where(own, spent, spend)[stay]
                    if up and inner:
                        near = (value < 0) & (value * value <= most)
                        guests, costs = np.r_[guests, h[near]], np.r_[costs, (value * value)[near]]
                    todo.append((h[(value >= 0) == up], guests, costs, rest))
                continue
        ours, theirs = rough[h], rough[g]
        for k in range(0, len(h), 512):
            part = slice(k, k + 512)
            if inner:
                for m in range(k, len(h), 4096):
                    other = slice(m, m + 4096)
                    i, j = alike(vec, h[part], h[other], ours[part], ours[other], least)
                    after = j + m > i + k
                    yield h[i[after] + k], h[j[after] + m]
            for m in range(0, len(g), 4096):
                other = slice(m, m + 4096)
                i, j = alike(vec, h[part], g[other], ours[part], theirs[other], least)
                yield h[i + k], g[j + m]


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """(id, n_links, component, kept) per row: links have equal labels and a cosine of at least `least`.

    Vectors that are null, empty or zero, or that hold null or non-finite components, and those without label have no link;
    their component is their own id. Vectors of other dimensions are apart. Copies are one node of the search and count as
    linked to each other, repeated rows too. Rows with a null id count as links and join what they link to; their own component
    is the smallest id there, null if there is none.
    """
    spark = rows.sparkSession
    number = "float" if isinstance(getattr(rows.schema[vector_col].dataType, "elementType", None), FloatType) else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v"), "label")
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.reverse("v"), F.lit(1), F.col("label")))})
    once = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # A number for each distinct vector; it is final once the table is written.
    reps = materialize(once.select(F.monotonically_increasing_id().alias("node"), "*", F.size("v").alias("dims")))
    total = reps.count()
    if not total:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    with batch_rows(spark, 5000):
        learnt = spark.sparkContext.broadcast(rotations(reps))
        tied = materialize(ties(reps, least, learnt))
        sizes = materialize(tied.groupBy("tie").agg(F.count("*").alias("n")).where("n > 1"))
        found = materialize(links(reps, tied, sizes, least, total).unionByName(untied_links(reps, tied, least, learnt)))
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = materialize(reps.select("node", "k1", "k2", "id", "n").join(direct, "node", "left").join(reach, "node", "left").withColumn("class", F.coalesce("component", "node")))
    least_id = materialize(named.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("c")))
    known = lookup_join(named.drop("component"), least_id, ["class"], "c", total)
    known = materialize(known.select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("least").alias("component")))
    for used in (reps, tied, sizes, found, named, least_id):
        discard(used)
    plain = materialize(rows.drop("v", "label"))
    linked = lookup_join(plain.where("k1 is not null"), known, ["k1", "k2"], "n", plain.count())
    alone = plain.where("k1 is null").select("k1", "k2", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    both = linked.select("k1", "k2", "id", "n_links", "component").unionByName(alone)
    component = F.coalesce("component", "id")
    return both.select("id", "n_links", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def rotations(reps: DataFrame) -> dict[int, Rotation]:
    """A learnt rotation for each dimension of which the sample (the first vectors by their hash) has some."""
    widest = reps.agg(F.max("dims")).first()[0]
    sample = reps.orderBy("k1", "k2").limit(max(64, min(SAMPLE, SAMPLE_VALUES // widest))).select("dims", "v").collect()
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(r.dims, []).append(r.v)
    return {d: Rotation(d, np.array(v, np.float64)) for d, v in by_dims.items()}


def ties(reps: DataFrame, least: float, learnt: Broadcast) -> DataFrame:
    """(node, tie): vectors that tables tie together, directly or over others, have the same tie."""
    most = radius(least)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = np.zeros((len(b), 2), np.uint64)
            for dims, at in b.reset_index(drop=True).groupby("dims").indices.items():
                codes[at] = rotation_of(learnt.value, int(dims)).codes(np.array(b["v"].iloc[at].tolist(), np.float64).reshape(len(at), -1))
            yield b[["node", "kind"]].assign(one=codes[:, 0].view(np.int64), two=codes[:, 1].view(np.int64))

    codes = materialize(reps.select("node", F.xxhash64("label", "dims").alias("kind"), "dims", "v").mapInPandas(coded, "node long, kind long, one long, two long"))
    same = ["kind", "one", "two"]
    alike = materialize(codes.groupBy(*same).agg(F.min("node").alias("node"), F.count("*").alias("n")))
    bits = key_bits(alike.groupBy("kind").count().agg(F.max("count")).first()[0])
    masks = bit_masks(tables(least, bits), bits)

    def masked(t: F.Column, level: int) -> list[F.Column]:
        pick = lambda w: F.element_at(F.array(*[F.lit(m[level][w]) for m in masks]), t + 1)
        return [F.col("one").bitwiseAND(pick(0)), F.col("two").bitwiseAND(pick(1))]

    rows = alike.withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(len(masks))])))
    rows = rows.select(F.xxhash64("kind", "t", *masked(F.col("t"), 0)).alias("key"), "t", "node", "one", "two")
    # A bucket that is too large is split by more of the code's bits, until all are in use; codes are distinct then.
    for level in range(1, len(masks[0])):
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET))
        if not hot.limit(1).count():
            break
        longer = F.xxhash64("key", *masked(F.col("t"), level))
        rows = rows.join(hot, "key", "left").select(F.when(F.col("c").isNull(), F.col("key")).otherwise(longer).alias("key"), "t", "node", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, one, two in whole_groups(batches):
            child, root = bucket_ties(key, one.view(np.uint64), two.view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root])], ["a", "b"])

    met = rows.select("key", "node", "one", "two").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    reach = components(met)
    tie = materialize(alike.join(reach, "node", "left").select(*same, "n", F.coalesce("component", "node").alias("tie")))
    return lookup_join(codes, tie, same, "n", codes.count()).select("node", "tie")


def links(reps: DataFrame, tied: DataFrame, sizes: DataFrame, least: float, total: int) -> DataFrame:
    """(node, links, root): links of each node, by groups, and another node of its class."""
    some = lookup_join(tied, sizes.withColumn("c", F.col("n")), ["tie"], "n", total, "inner")
    dealt = some.join(reps.select("node", "n", "v"), "node").withColumn("parts", F.ceil(F.col("c") / PART).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    group = F.xxhash64("tie", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(group.alias("group"), "own", (F.col("own") != F.col("other")).alias("cross"), "node", "n", "v")

    def columns(t: pa.Table) -> tuple[np.ndarray, ...]:
        return (*(c.to_numpy() for c in t.columns[:-1]), t.columns[-1].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, own, cross, node, n, vec in map(columns, whole_tables(batches)):
            # Vectors of a group have one dimension; groups of others are apart.
            size = np.fromiter(map(len, vec), np.int64, len(vec))
            for dims in np.unique(size):
                at = np.flatnonzero(size == dims)
                matrix = np.array([vec[k] for k in at], np.float64)
                found, count, root = group_links(group[at], own[at], cross[at], matrix, n[at], least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[at][found], count, node[at][root])], ["node", "links", "root"])

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, "node long, links long, root long")


def untied_links(reps: DataFrame, tied: DataFrame, least: float, learnt: Broadcast) -> DataFrame:
    """(node, links, root) as of `links`, for the links between vectors that have no tie."""
    rows = reps.withColumn("kind", F.xxhash64("label", "dims"))
    kinds = rows.groupBy("kind").agg(F.count("*").alias("c"), F.first("dims").alias("d")).where(F.col("c") * F.col("d") > VALUES)
    large = materialize(kinds.select("kind", F.ceil(F.log2(F.col("c") * F.col("d") / VALUES)).cast("int").alias("bits")))
    rows = rows.join(tied, "node").join(F.broadcast(large), "kind", "left").select("kind", "node", "tie", "n", "dims", F.coalesce("bits", F.lit(0)).alias("bits"), "v")
    most = room(least)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, bits = b.column("dims").to_numpy(), b.column("bits").to_numpy()
            for d, n in {*zip(dims.tolist(), bits.tolist(), strict=True)}:
                some = b.filter(pa.array((dims == d) & (bits == n)))
                rotation = rotation_of(learnt.value, d)
                row, cell, home = cells(rotation.places(units(matrix(some.column("v"), d))), min(n, rotation.axes.shape[1]), most)
                for k in range(0, len(row), 5000):
                    cut = slice(k, k + 5000)
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(row[cut])).columns, pa.array(cell[cut]), pa.array(home[cut])], [*some.schema.names, "cell", "home"])

    if large.limit(1).count():
        number = rows.schema["v"].dataType.simpleString()
        few = rows.where("bits = 0").select("*", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"))
        many = rows.where("bits > 0").mapInArrow(placed, f"kind long, node long, tie long, n long, dims int, bits int, v {number}, cell long, home boolean")
        sizes = many.groupBy("kind", "cell").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("all"), F.first("dims").alias("d"))
        parts = F.ceil(F.col("h") * F.col("d") / VALUES).cast("int")
        sizes = materialize(sizes.select("kind", "cell", parts.alias("hp"), F.ceil((F.col("all") - F.col("h")) * F.col("d") / (4 * VALUES)).cast("int").alias("gp")).where("hp > 1 or gp > 1"))
        rows = few.unionByName(many).join(F.broadcast(sizes), ["kind", "cell"], "left")
    else:
        rows = rows.select("*", F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(1).alias("hp"), F.lit(1).alias("gp"))
    rows = rows.withColumns({"hp": F.greatest(F.coalesce("hp", F.lit(1)), F.lit(1)), "gp": F.greatest(F.coalesce("gp", F.lit(1)), F.lit(1))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("home"), F.col("hp")).otherwise(F.col("gp"))).cast("int"))
    # Home part q meets: by source 0 itself and the first guests, then other guests, then each part before it.
    met = F.expr("""if(home,
        concat(transform(sequence(0, gp + own - 1), c -> struct(own as q, c as c, true as ours)),
            if(own + 1 < hp, transform(sequence(own + 1, hp - 1), q -> struct(q as q, gp + own as c, false as ours)), array())),
        transform(sequence(0, hp - 1), q -> struct(q as q, own as c, false as ours)))""")
    rows = rows.withColumn("met", F.explode(met))
    rows = rows.select(F.xxhash64("kind", "cell", "met.q", "met.c").alias("group"), "met.ours", (F.col("met.c") == 0).alias("inner"), "node", "tie", "n", "dims", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tables(batches):
            group, ours, inner, node, tie, n, dims = (c.to_numpy() for c in t.columns[:-1])
            links, forest = np.zeros(len(group), np.int64), Forest(len(group))
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s < 2 or not ours[s:e].any():
                    continue
                unit = units(matrix(t.columns[-1].slice(s, e - s).combine_chunks(), int(dims[s])))
                place = rotation_of(learnt.value, int(dims[s])).places(unit) if (e - s) ** 2 > SMALL else np.zeros((e - s, 0))
                for i, j in cell_links(unit, place, ours[s:e], bool(inner[s]), least):
                    i, j = i + s, j + s
                    apart = tie[i] != tie[j]
                    i, j = i[apart], j[apart]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    forest.fold(i, j)
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[found], links[found], node[forest.label[found]])], ["node", "links", "root"])

    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "node long, links long, root long")


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def whole_tables(batches: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[pa.Table]:
    """Rows sorted by the first column, cut only where it changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= least:
            t = pa.Table.from_batches(held)
            first = t.column(0).to_numpy()
            cut = int(np.searchsorted(first, first[-1]))
            if cut:
                yield t.slice(0, cut)
            held, size = t.slice(cut).combine_chunks().to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)
