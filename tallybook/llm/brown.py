"""Brown class-based n-gram scoring.

P(w | v) = P(class of w | class of v) * P(w | class of w), mixed with the add-one unigram. Classes come from exchange
clustering in two steps, as in distributed exchange: the most frequent words, and all others lumped by shape (length band and
last byte), are exchanged against each other on the driver, on a table of fixed size; then every other word seen LEAST times or
more in training is moved to the class that fits its neighbours best, from its counts against the neighbours' classes over
the whole corpus. So the clustered vocabulary grows with the corpus. Rarer and unseen words keep the class of their shape.

Counts cover every word of every training text. Texts are first packed into blocks: token numbers of a block-wide vocabulary,
and that vocabulary as 64-bit hashes with training counts. Hashes, not texts, are then shuffled: once to add up the counts and
neighbours of a word over all blocks (a word counts once a block, however often it stands there), once to bring sum and class
back to the block. Words travel in packets, those of a block that fall into one bucket of hashes; there are as many buckets as it
takes to keep one small. A block's texts are kept and read in runs, so memory follows the run and the block's vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import discard, materialize, small_batches

#: Bytes of text and distinct words that end a block; tokens handled at once.
BLOCK, BLOCK_WORDS, RUN = 32_000_000, 250_000, 400_000
#: Words of all blocks that a bucket holds, about.
BUCKET_WORDS = 150_000
#: Most frequent words, exchanged on the driver, and classes (at most 127).
WORDS, CLASSES = 512, 48
SHAPES = 64
#: Training count from which a word is given a class by its neighbours.
LEAST = 2
#: Share of the class model in the mixture; added to transition counts; taken off each word's count in its class.
MIX, ADD_CLASS, DISCOUNT = 0.85, 0.1, 0.75
FOLDS, HELD = 7, 2
#: No word has white space, so the end's hash is that of a line feed.
END = b"\n"
#: A word's share in some block from which it may be one of the most frequent.
SHARE_IN_BLOCK = 2.0**-17


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shape(word: bytes) -> int:
    """One of SHAPES groups by length band and last byte."""
    return min(len(word) // 3, 3) * 16 + word[-1] % 16


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 3)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def packed(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of docs (doc_id, text, held_out), each within a task; its number holds the partition and the order in it. tokens
    and lengths are lists, one entry a run of whole texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        numbers, counts, ids, held, runs, sizes, lines, size, room = _Numbers({END: 0}), np.zeros(1, np.uint32), [], [], [], [], [], 0, RUN

        def close() -> None:
            """Packs the texts since the last run."""
            nonlocal counts, lines, room
            lengths = np.fromiter(map(len, lines), np.int32, len(lines))
            flat = np.concatenate(lines)
            learnt = np.repeat(~np.array(held[len(held) - len(lines) :], bool), lengths)
            counts = np.concatenate([counts, np.zeros(len(numbers) - len(counts), np.uint32)]) + np.bincount(flat[learnt], minlength=len(numbers)).astype(np.uint32)
            runs.append(_pack(flat))
            sizes.append(_pack(lengths))
            lines, room = [], RUN

        def block() -> pd.DataFrame:
            nonlocal numbers, counts, ids, held, runs, sizes, size, made
            if lines:
                close()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            shapes = np.fromiter(map(shape, numbers), np.uint8, len(numbers))
            order = np.argsort(hashes).astype(np.uint32)
            row = {"block": (part << 16) + made, "ids": [ids], "held": [held], "lengths": [sizes], "tokens": [runs], "hashes": [hashes.tobytes()], "shapes": [_pack(shapes)], "counts": [_pack(counts)], "order": [_pack(order)]}
            made += 1
            numbers, counts, ids, held, runs, sizes, size = _Numbers({END: 0}), np.zeros(1, np.uint32), [], [], [], [], 0
            return pd.DataFrame(row)

        for b in batches:
            for i, t, h in zip(b["doc_id"], b["text"], b["held_out"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.lower().split()
                line = np.zeros(len(words) + 1, np.uint32)
                line[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                ids.append(None if i is None or i != i else int(i))
                held.append(bool(h))
                lines.append(line)
                room -= len(line)
                size += len(raw) + 1
                if room <= 0:
                    close()
                if size >= block_bytes or len(numbers) >= BLOCK_WORDS:
                    yield block()
        if ids:
            yield block()

    schema = "block long, ids array<long>, held array<boolean>, lengths array<binary>, tokens array<binary>, hashes binary, shapes binary, counts binary, order binary"
    return docs.select("doc_id", "text", "held_out").mapInPandas(run, schema)


def _runs(tokens: list[bytes], lengths: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which texts of the block, their tokens, their lengths) of each run."""
    at = 0
    for t, n in zip(tokens, lengths, strict=True):
        sizes = _unpack(n, "<i4")
        yield slice(at, at + len(sizes)), _unpack(t, "<u4"), sizes
        at += len(sizes)


def core_words(blocks: DataFrame, words: int) -> np.ndarray:
    """Hashes of the most frequent words of the training texts, sorted.

    A word as frequent as that has a share of SHARE_IN_BLOCK or more in some block; such words are candidates, at most
    1 / SHARE_IN_BLOCK of a block, and the best are counted again over all blocks.
    """

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, c in zip(b["hashes"], b["counts"], strict=True):
                n = _unpack(c, "<u4").astype(np.int64)
                some = np.flatnonzero((n > 0) & (n >= n.sum() * SHARE_IN_BLOCK))
                yield pd.DataFrame({"h": np.frombuffer(h, np.int64)[some], "n": n[some]})

    rows = blocks.select("hashes", "counts")
    add = lambda df: df.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h")
    near = np.sort(np.array([r.h for r in add(rows.mapInPandas(likely, "h long, n long")).limit(8 * words).collect()], np.int64))
    if not len(near):
        return np.empty(0, np.uint64)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, c in zip(b["hashes"], b["counts"], strict=True):
                own = np.frombuffer(h, np.int64)
                at = np.flatnonzero(np.isin(own, near))
                yield pd.DataFrame({"h": own[at], "n": _unpack(c, "<u4")[at].astype(np.int64)})

    found = add(rows.mapInPandas(exact, "h long, n long")).limit(words).collect()
    return np.sort(np.array([r.h & (2**64 - 1) for r in found], np.uint64))


def exchange(n: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of every unit: starting from classes by rank of frequency, units move one at a time to the class that raises the
    likelihood of the class bigrams most, until a sweep moves none (or sweeps are used up). n: bigram counts of units."""
    units = len(n)
    f = lambda x: x * np.log(np.maximum(x, 1))
    of = np.empty(units, int)
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    table = member.T @ n @ member
    rows, cols = n @ member, (member.T @ n).T
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, self_ = of[u], n[u, u]
            r, c = rows[u].copy(), cols[u].copy()
            r[old] -= self_
            c[old] -= self_
            table[old, :] -= r
            table[:, old] -= c
            table[old, old] -= self_
            right, left = table.sum(1), table.sum(0)
            new_r, new_c = table + r[None, :], table + c[:, None]
            new_r[diagonal, diagonal] += c + self_
            new_c[diagonal, diagonal] = 0
            old_c = table.copy()
            old_c[diagonal, diagonal] = 0
            gain = f(new_r).sum(1) - f(table).sum(1) + f(new_c).sum(0) - f(old_c).sum(0)
            gain -= f(right + r.sum() + self_) - f(right) + f(left + c.sum() + self_) - f(left)
            best = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            table[best, :] += r
            table[:, best] += c
            table[best, best] += self_
            if best != old:
                of[u] = best
                moved += 1
                rows[:, old] -= n[:, u]
                rows[:, best] += n[:, u]
                cols[:, old] -= n[u, :]
                cols[:, best] += n[u, :]
        if not moved:
            break
    return of


def bigrams(blocks: DataFrame, top: np.ndarray) -> np.ndarray:
    """Counts of unit pairs in training texts; an end comes before every text. At most (WORDS + SHAPES)^2 rows reach the driver."""
    units = len(top) + SHAPES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, s, t, n, held in zip(b["hashes"], b["shapes"], b["tokens"], b["lengths"], b["held"], strict=True):
                unit = unit_of(np.frombuffer(h, np.uint64), _unpack(s, "u1"), top)
                total = np.zeros(units * units, np.int64)
                for texts, flat, lengths in _runs(t, n):
                    seq = unit[flat]
                    before, _ = _around(seq, lengths, unit[0])
                    learnt = np.repeat(~np.array(held[texts], bool), lengths)
                    total += np.bincount((before.astype(np.int64) * units + seq)[learnt], minlength=units * units)
                pair = np.flatnonzero(total)
                yield pd.DataFrame({"pair": pair, "n": total[pair]})

    found = blocks.select("hashes", "shapes", "tokens", "lengths", "held").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(units * units)
    table[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return table.reshape(units, units)


def unit_of(hashes: np.ndarray, shapes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Unit of each word: its place among the top words (sorted by hash), else its shape's."""
    at = np.searchsorted(top, hashes).clip(0, max(0, len(top) - 1))
    other = len(top) + shapes.astype(np.int32)
    return np.where(top[at] == hashes, at, other).astype(np.int32) if len(top) else other


def class_fits(between: np.ndarray) -> np.ndarray:
    """(2 * classes, classes): what a left neighbour of each class, then a right one, adds to the fit of a word to each class."""
    soft = between + ADD_CLASS
    return np.vstack([np.log(soft / soft.sum(0)[None, :]), np.log(soft / soft.sum(1)[:, None]).T]).astype(np.float32)


def neighbours(blocks: DataFrame, top: np.ndarray, of: np.ndarray, classes: int, bits: int) -> DataFrame:
    """(bucket, block, words, packet): words of a block in order of their hashes, cut where a bucket of `bits` bits ends.

    A packet holds the hashes, for core words their class less 128 and for others the class of their shape, the sizes of what
    follows for each, and that: for core words the training count, for others the classes of the neighbours of each training
    token, a byte each (left ones, right ones raised by classes).
    """
    names = ["bucket", "block", "words", "packet"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                hashes, order = np.frombuffer(r["hashes"], np.uint64), _unpack(r["order"], "<u4")
                unit = unit_of(hashes, _unpack(r["shapes"], "u1"), top)
                cls, core = of[unit].astype(np.int16), unit < len(top)
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                seen = []
                for texts, flat, lengths in _runs(r["tokens"], r["lengths"]):
                    before, after = _around(cls[flat], lengths, cls[0])
                    learnt = np.repeat(~np.array(r["held"][texts], bool), lengths) & ~core[flat]
                    seen.append((rank[flat[learnt]], np.stack([before[learnt], after[learnt] + classes], 1).astype(np.uint8)))
                word, pairs = (np.concatenate(x) for x in zip(*seen, strict=True))
                pairs = pairs[np.argsort(word, kind="stable")]
                core, hashes = core[order], hashes[order]
                sizes = np.where(core, 4, np.bincount(word, minlength=len(hashes))).astype(np.uint32)
                # Counts of core words take the room of four pairs.
                table = np.empty((int(sizes.sum()), 2), np.uint8)
                table[np.repeat(~core, sizes)] = pairs
                table[np.repeat(core, sizes)] = _unpack(r["counts"], "<u4")[order][core].astype("<i8").view(np.uint8).reshape(-1, 2)
                ends, told = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.where(core, cls[order] - 128, cls[order]).astype(np.int8)
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                packets = [zstandard.compress(hashes[i:j].tobytes() + told[i:j].tobytes() + sizes[i:j].tobytes() + table[ends[i] : ends[j]].tobytes(), 1) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                columns = [bucket[edge[:-1]], np.full(len(packets), r["block"], np.int64), np.diff(edge).astype(np.int32), packets]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), pa.array(packets, pa.binary())], names)

    return blocks.select("block", "held", "lengths", "tokens", "hashes", "shapes", "counts", "order").mapInArrow(run, "bucket long, block long, words int, packet binary")


def _around(cls: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class before and after each token; an end stands before every text, and after its own end."""
    before, after = np.empty_like(cls), np.empty_like(cls)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    stop = np.cumsum(lengths)
    before[stop - lengths], after[stop - 1] = end, end
    return before, after


def assigned(rows: DataFrame, fits: np.ndarray, least: int = LEAST) -> DataFrame:
    """(block, bucket, packet) of each packet: in the same order, the training count of each word over all blocks, and its class,
    raised by 128 in the one packet that counts for the word."""
    wide = len(fits)

    def whole(words: np.ndarray, packets: list[bytes]) -> list[bytes]:
        """All packets of one bucket."""
        parts = [], [], [], []
        for n, p in zip(words.tolist(), packets, strict=True):
            raw = zstandard.decompress(p)
            for part, kind, at, count in zip(parts, ("<u8", "i1", "<u4", "u1"), (0, 8 * n, 9 * n, 13 * n), (n, n, n, -1), strict=True):
                part.append(np.frombuffer(raw, kind, count, at))
        h, cls, size, data = map(np.concatenate, parts)
        core, size = cls < 0, size.astype(np.int64)
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        owner, own = np.repeat(group, size), np.repeat(core, size)
        n = size.copy()
        n[core] = data.reshape(-1, 2)[own].ravel().view("<i8")
        total = np.zeros(len(first), np.int64)
        np.add.at(total, group, n)
        best = np.where(core, cls.astype(np.int16) + 128, cls)[first]
        open_ = (total >= least) & ~core[first]
        keep = ~own & open_[owner]
        number, chosen = np.cumsum(open_) - 1, np.flatnonzero(open_)
        slot, codes = number[owner[keep]], data.reshape(-1, 2)[keep]
        order = np.argsort(slot, kind="stable")
        slot, codes = slot[order], codes[order]
        for k in range(0, len(chosen), 20_000):
            stop = min(k + 20_000, len(chosen))
            a, b = np.searchsorted(slot, (k, stop))
            at = (slot[a:b, None] - k) * wide + codes[a:b]
            table = np.bincount(at.ravel(), minlength=(stop - k) * wide).reshape(-1, wide).astype(np.float32)
            best[chosen[k:stop]] = np.argmax(table @ fits, 1)
        told = best[group].astype(np.uint8)
        told[first] += 128
        sums, out, at = total[group], [], 0
        for k in words.tolist():
            out.append(zstandard.compress(sums[at : at + k].tobytes() + told[at : at + k].tobytes(), 1))
            at += k
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, block, words = (t.column(k).to_numpy() for k in range(3))
            packets = t.column(3).to_pylist()
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(block[i:j]), pa.array(bucket[i:j]), pa.array(whole(words[i:j], packets[i:j]), pa.binary())], ["block", "bucket", "packet"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                t = pa.Table.from_batches(held)
                first = t.column(0).to_numpy()
                cut = int(np.searchsorted(first, first[-1]))
                if cut:
                    yield from flush(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket long, packet binary")


def classed(blocks: DataFrame, words: DataFrame, classes: int) -> DataFrame:
    """Blocks with their words' counts and classes in place of hashes, and what their training texts add to the model."""

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        raw = [zstandard.decompress(p) for p in found.sort_values("bucket")["packet"]]
        counts, told = (np.concatenate([np.frombuffer(r, kind, len(r) // 9, at * (len(r) // 9)) for r in raw]) for kind, at in (("<i8", 0), ("u1", 8)))
        for b in block.itertuples(index=False):
            order = _unpack(b.order, "<u4")
            n, cls, one = np.empty(len(order), np.int64), np.empty(len(order), np.uint8), told >= 128
            n[order], cls[order] = counts, told & 127
            types = np.bincount(told[one & (counts > 0)] & 127, minlength=classes)
            moves = np.zeros(classes * classes, np.int64)
            for texts, flat, lengths in _runs(b.tokens, b.lengths):
                before, _ = _around(cls[flat], lengths, cls[0])
                learnt = np.repeat(~np.array(b.held[texts], bool), lengths)
                moves += np.bincount(before[learnt].astype(np.int64) * classes + cls[flat][learnt], minlength=classes * classes)
            out.append({"ids": b.ids, "held": b.held, "lengths": b.lengths, "tokens": b.tokens, "n": _pack(n), "cls": _pack(cls), "types": types.tolist(), "moves": moves.tolist()})
        return pd.DataFrame(out, columns=["ids", "held", "lengths", "tokens", "n", "cls", "types", "moves"])

    schema = "ids array<long>, held array<boolean>, lengths array<binary>, tokens array<binary>, n binary, cls binary, types array<long>, moves array<long>"
    whole = blocks.select("block", "ids", "held", "lengths", "tokens", "order").groupBy("block")
    return whole.cogroup(words.groupBy("block")).applyInPandas(run, schema)


def _added(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums of an array column by position; `size` rows reach the driver."""
    out = np.zeros(size, np.int64)
    for r in rows.select(F.posexplode(column).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def score(docs: DataFrame, words: int = WORDS, classes: int = CLASSES, least: int = LEAST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Learns from rows whose fold is not HELD. Null texts count as empty: their one token is the end. Repeated rows count as
    often as they stand there; null ids stay null and are learnt from. Without training texts, score is base_score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id")) == HELD).alias("held_out"))
    blocks = materialize(packed(rows))
    top = core_words(blocks, words)
    pairs = bigrams(blocks, top)
    of = exchange(pairs, classes)
    member = np.eye(classes)[of]
    fits = class_fits(member.T @ pairs @ member)
    words_ = blocks.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    bits = max(0, ceil(log2(max(words_, 1) / BUCKET_WORDS)))
    known = materialize(classed(blocks, assigned(neighbours(blocks, top, of, classes, bits), fits, least), classes))
    discard(blocks)
    types, moves = _added(known, "types", classes), _added(known, "moves", classes * classes).reshape(classes, classes)
    tokens, distinct = int(moves.sum()), int(types.sum())
    move = np.log10((moves + ADD_CLASS) / (moves.sum(1, keepdims=True) + ADD_CLASS * classes))
    inside, schema = moves.sum(0), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                n, cls = _unpack(b.n, "<i8"), _unpack(b.cls, "u1")
                base = (n + 1) / (tokens + distinct + 1)
                all_, kinds = inside[cls], types[cls]
                # What is taken off goes to the class's words by their unigram shares.
                own = base * (tokens + distinct + 1) / np.maximum(all_ + kinds, 1)
                emit = np.log10(np.where(all_ > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * own) / np.maximum(all_, 1), base))
                base = np.log10(base)
                for texts, part, sizes in _runs(b.tokens, b.lengths):
                    at, own, each = np.cumsum(sizes) - sizes, cls[part], base[part]
                    before, _ = _around(own, sizes, cls[0])
                    mixed = np.log10(MIX * 10 ** (move[before, own] + emit[part]) + (1 - MIX) * 10**each) if tokens else each
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(list(b.ids[texts]), "Int64"), "held_out": list(b.held[texts]), "n_tokens": sizes.astype(np.int64),
                            "n_known": np.add.reduceat((n[part] > 0).astype(np.int64), at), "train_tokens": tokens, "base_score": np.add.reduceat(each, at), "score": np.add.reduceat(mixed, at),
                        }
                    )

    return known.select("ids", "held", "lengths", "tokens", "n", "cls").mapInPandas(run, schema)
