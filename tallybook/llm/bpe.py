"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text where its content says so, so passages that documents share come out as the same
chunks wherever they stand. Chunks shared across documents are counted over the whole corpus; those that save most are encoded
once, and their identifiers are sent to every task. Other chunks are encoded once per task while its bounded cache holds them.

Chunks are cut anywhere, so tokens at their joins may be wrong. A join is repaired by encoding the text around it again, from
a place left of it to a place right of it where the tokenizer splits in any context (a space after a visible ASCII character), and the result
is taken when it agrees with the chunks' own tokens at both ends; else the window grows, at last to the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import small_batches

#: Shared chunks sent to every task: those that save most, up to this many bytes of text and this many chunks.
SHARED_BYTES, SHARED = 8_000_000, 32_768
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 96, 9, 4096
#: Chunks a task remembers.
CACHED = 16384
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, np.uint32)
#: Characters on which pattern libraries may differ, or that are not Latin.
_ODD = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: Words a task remembers the tokens of.
PIECES = 200_000


def cuts(data: bytes) -> list[int]:
    """Chunk borders from 0 to len(data); never inside a UTF-8 character."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [0, n]
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    found, last = [0], 0
    for at in (np.flatnonzero((h & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last = _whole(data, last + MAX_CHUNK)
            found.append(last)
        if at - last >= MIN_CHUNK and at < n and data[at] & 0xC0 != 0x80:
            found.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last = _whole(data, last + MAX_CHUNK)
        found.append(last)
    return [*found, n]


def _whole(data: bytes, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


@lru_cache(1)
def latin_pattern() -> re.Pattern:
    """The tokenizer's split of a text, for characters below U+0250."""
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k)
    letters, digits = kind("L"), kind("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")


class Pieces(dict):
    """Tokens of the words a text is split into."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= PIECES:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    """Encodes and decodes with the vocabulary of one tokenizer file, exactly as the tokenizers library does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        added = {t["id"]: t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]}
        self.special = tuple(added.values())
        #: Bytes stand for themselves where printable, else for characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        size = self.exact.get_vocab_size()
        words = [self.exact.id_to_token(i) for i in range(size)]
        self.bytes = [added[i].encode() if i in added else bytes(byte_of[c] for c in w) for i, w in enumerate(words)]
        self.sizes = list(map(len, self.bytes))
        self.decimal = [str(i) for i in range(size)]
        self.pieces = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            # Words come split already, so each is one piece.
            core = tiktoken.Encoding(path, pat_str="[\\s\\S]+", mergeable_ranks=table, special_tokens={})
            self.pieces = Pieces(core.encode_ordinary)

    def encode(self, text: str) -> list[int]:
        """The library's own result. Latin texts without special tokens are split here and their words looked up."""
        if self.pieces is None or _ODD.search(text) or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.pieces.__getitem__, latin_pattern().findall(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _safe(data: bytes, at: int) -> bool:
    return 0 < at < len(data) and data[at] == 32 and 32 < data[at - 1] < 127


def _before(data: bytes, at: int) -> int:
    """The last safe place before at, or 0."""
    while (at := data.rfind(b" ", 0, at)) > 0:
        if 32 < data[at - 1] < 127:
            return at
    return 0


def _after(data: bytes, at: int) -> int:
    """The first safe place after at, or the end."""
    while (at := data.find(b" ", at + 1)) > 0:
        if 32 < data[at - 1] < 127:
            return at
    return len(data)


def _upto(ids: list[int], sizes: list[int], n: int) -> int:
    """How many of ids make up n bytes; -1 if a token reaches over."""
    at = k = 0
    while at < n:
        at += sizes[ids[k]]
        k += 1
    return k if at == n else -1


def _down(ids: list[int], sizes: list[int], n: int) -> int:
    """The first of the last ids that make up n bytes; -1 if a token reaches over."""
    at, k = 0, len(ids)
    while at < n:
        k -= 1
        at += sizes[ids[k]]
    return k if at == n else -1


def encode_whole(data: bytes, coder: Codec, chunk_ids: Callable[[bytes], list[int]]) -> list[int]:
    """Tokens of a whole text from the tokens of its chunks, joins repaired."""
    borders = cuts(data)
    if len(borders) == 2:
        return chunk_ids(data) if data else []
    chunks = [chunk_ids(data[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
    windows: list[list] = []
    for k, b in enumerate(borders[1:-1]):
        if _safe(data, b):
            continue
        left, right = _before(data, b), _after(data, b)
        lo, hi = _before(data, left), _after(data, right)
        while True:
            ids = coder.encode(data[lo:hi].decode())
            if _agrees(ids, chunks[k], chunks[k + 1], borders[k], b, borders[k + 2], lo, left, right, hi, coder.sizes):
                break
            lo, hi, left, right = _before(data, lo), _after(data, hi), lo, hi
        if windows and lo < windows[-1][1]:
            lo, hi = windows[-1][0], max(hi, windows[-1][1])
            windows[-1] = [lo, hi, coder.encode(data[lo:hi].decode())]
        else:
            windows.append([lo, hi, ids])
    out: list[int] = []
    at = 0
    for a, b, ids in zip(borders, borders[1:], chunks, strict=False):
        while at < len(windows) and windows[at][1] <= a:
            at += 1
        start, stop, w = a, b, at
        if w < len(windows) and windows[w][0] < a:
            start = min(b, windows[w][1])
            w += start < b or windows[w][1] == b
        ends = w < len(windows) and windows[w][0] < b and windows[w][0] >= start
        if ends:
            stop = windows[w][0]
        if start < stop:
            out += ids[_upto(ids, coder.sizes, start - a) : _down(ids, coder.sizes, b - stop)] if (start, stop) != (a, b) else ids
        if ends:
            out += windows[w][2]
    return out


def _agrees(ids: list[int], one: list[int], two: list[int], a: int, b: int, c: int, lo: int, left: int, right: int, hi: int, sizes: list[int]) -> bool:
    """Whether a window's tokens equal the chunks' own from lo to left and from right to hi, as far as these lie in the two chunks."""
    if lo >= a and lo > 0:
        i, j, k = _down(one, sizes, b - lo), _down(one, sizes, b - left), _upto(ids, sizes, left - lo)
        if min(i, j, k) < 0 or one[i:j] != ids[:k]:
            return False
    if hi <= c and right < hi:
        i, j, k = _upto(two, sizes, right - b), _upto(two, sizes, hi - b), _down(ids, sizes, hi - right)
        if min(i, j, k) < 0 or two[i:j] != ids[k:]:
            return False
    return True


class Reuse:
    """Tokens of chunks: those shared across the corpus (as 32-bit numbers), and the task's own."""

    def __init__(self, coder: Codec, shared: dict[bytes, bytes]) -> None:
        self.coder, self.shared, self.own = coder, shared, {}

    def __call__(self, chunk: bytes) -> list[int]:
        ids = self.own.get(chunk)
        if ids is None:
            if len(self.own) >= CACHED:
                self.own.clear()
            packed = self.shared.get(chunk)
            ids = self.own[chunk] = np.frombuffer(packed, "<u4").tolist() if packed is not None else self.coder.encode(chunk.decode())
        return ids


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def shared_chunks(docs: DataFrame, path: str, text_col: str = "text", most_bytes: int = SHARED_BYTES, most: int = SHARED) -> dict[bytes, bytes]:
    """Tokens of the chunks whose reuse saves most bytes, each encoded once; counted over all documents. Each is taken from one
    text that has it, so only such texts are cut again."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            seen: dict[int, tuple[int, int]] = {}
            for t, k in zip(b["text"], b["k"], strict=True):
                data = _bytes(t)
                borders = cuts(data)
                for x, y in zip(borders, borders[1:], strict=False):
                    h = xxhash.xxh3_64_intdigest(data[x:y])
                    n[h] += 1
                    seen[h] = (y - x, k)
            yield pd.DataFrame({"h": np.fromiter(n, np.uint64, len(n)).view(np.int64), "n": list(n.values()), "size": [seen[h][0] for h in n], "k": [seen[h][1] for h in n]})

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("k"))
    counts = texts.mapInPandas(count, "h long, n long, size long, k long").groupBy("h").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min("k").alias("k"))
    best, room = [], most_bytes
    for r in counts.where("n > 1").orderBy(F.desc(F.col("n") * F.col("size")), "h").limit(most).collect():
        room -= r["size"]
        if room >= 0:
            best.append(r)
    if not best:
        return {}
    wanted = frozenset(r.h & (2**64 - 1) for r in best)
    carriers = docs.sparkSession.createDataFrame([(k,) for k in {r.k for r in best}], "k long")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, done = set(wanted), set()
        coder = codec(path)
        for b in batches:
            found = {}
            for t, k in zip(b["text"], b["k"], strict=True):
                if k not in done:
                    done.add(k)
                    data = _bytes(t)
                    borders = cuts(data)
                    for x, y in zip(borders, borders[1:], strict=False):
                        h = xxhash.xxh3_64_intdigest(data[x:y])
                        if h in left:
                            left.discard(h)
                            found[h] = data[x:y]
            yield pd.DataFrame({"h": np.fromiter(found, np.uint64, len(found)).view(np.int64), "chunk": list(found.values()), "ids": [np.array(coder.encode(c.decode()), "<u4").tobytes() for c in found.values()]})

    # At most `most` numbers are broadcast.
    once = texts.join(F.broadcast(carriers), "k", "left_semi").mapInPandas(gather, "h long, chunk binary, ids binary").groupBy("h").agg(F.min(F.struct("chunk", "ids")).alias("x"))
    return {bytes(r.x.chunk): bytes(r.x.ids) for r in once.collect()}


def encoded(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep_ids: bool = True) -> DataFrame:
    """docs without text, with its tokens (array of int, column `out`, if keep_ids), n_tokens, ids_sha256 and decoded_sha256.

    Null texts count as empty and have no tokens. Repeated rows are encoded each for itself. Other columns stay, apart from
    columns of the names added.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(shared_chunks(docs, path, text_col))
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({out: "array<int>"} if keep_ids else {})
    rows = docs.drop(*[c for c in added if c != text_col])
    kept = [c for c in rows.columns if c != text_col]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        reuse = Reuse(coder, held.value)
        for b in batches:
            texts = b[text_col]
            made: dict[str, list] = {c: [] for c in added}
            for t in texts:
                ids = encode_whole(_bytes(t), coder, reuse)
                made["n_tokens"].append(len(ids))
                made["ids_sha256"].append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                if keep_ids:
                    made[out].append(np.array(ids, np.int32))
            yield b[kept].assign(**{c: pd.Series(v, index=b.index, dtype=object if c != "n_tokens" else "int64") for c, v in made.items()})

    return rows.mapInPandas(run, ", ".join([*fields, *(f"`{c}` {k}" for c, k in added.items())]))
