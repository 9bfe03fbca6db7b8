"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; all texts, those among them, are the unlabelled, whatever their label says. A linear
classifier over the presence of words and of their beginnings (other forms of a word share its stem) is trained in numpy on
the risk

    prior * E_p[loss(+f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

whose second term estimates the risk on unseen negatives; where it falls below zero, the step goes against it instead, so the
classifier can't gain from fitting the positives among the unlabelled. Every feature that is significantly more frequent among
the positives is used, however many there are; a text's features are held as a list of their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import discard, materialize, plain_words, small_batches

#: Documented bounds of the training sample: rows, chosen by a hash of their id.
POSITIVES, UNLABELLED = 4000, 12000
#: Lengths of word beginnings that are features too.
STARTS = (4, 5, 6)
#: Least documents of a feature and least z-score of its share among positives against unlabelled.
LEAST_DOCS, LEAST_Z = 3, 4.0
FOLDS = 5
#: Words a task remembers the features of.
REMEMBERED = 500_000


def features(text: str | None) -> set[bytes]:
    """Distinct words, and distinct beginnings of longer words, marked by a circumflex."""
    words = set(plain_words(text))
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in STARTS))


class _Hits(dict):
    """Numbers of the known features that a word brings; most words have none."""

    def __init__(self, number: dict[bytes, int]) -> None:
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        keys = (word, *(b"^" + word[:n] for n in STARTS if len(word) > n))
        self[word] = found = tuple(self.number[k] for k in keys if k in self.number)
        return found


@dataclass
class Model:
    """A bias and weights by feature; a score adds the weights of a text's features in their order."""

    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = sorted(self.weights)
        self.hits = _Hits({w: k for k, w in enumerate(names)})
        self.values = [self.weights[w] for w in names]

    def score(self, text: str | None) -> float:
        found = set().union(*map(self.hits.__getitem__, set(plain_words(text))))
        z = self.bias + sum(self.values[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-z)))


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


class Sparse:
    """Rows of a presence table as lists of column numbers, and the products that training needs."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.columns = np.fromiter((k for r in rows for k in r), np.int64, int(self.sizes.sum()))
        self.owner, self.shape = np.repeat(np.arange(len(rows)), self.sizes), (len(rows), width)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns], self.shape[0])

    def left(self, a: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, a[self.owner], self.shape[1])


def train(x_pos: np.ndarray | Sparse, x_unl: np.ndarray | Sparse, prior: float, n_pos: np.ndarray | None = None, n_unl: np.ndarray | None = None, rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss; n_pos and n_unl say how often a row counts."""
    p, u = (x if isinstance(x, Sparse) else Sparse([np.flatnonzero(r).tolist() for r in x], x.shape[1]) for x in (x_pos, x_unl))
    d = p.shape[1]
    w = np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    a, b = ((np.ones(x.shape[0]) if n is None else n) / (x.shape[0] if n is None else n.sum()) for x, n in ((p, n_pos), (u, n_unl)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    back = lambda x, e: np.append(x.left(e), e.sum())
    for t in range(1, rounds + 1):
        zp, zu = p @ w[:d] + w[d], u @ w[:d] + w[d]
        negative = b @ np.logaddexp(0, zu) - prior * (a @ np.logaddexp(0, zp))
        g_neg = back(u, b * sigmoid(zu)) - prior * back(p, a * sigmoid(zp))
        g = g_neg - prior * back(p, a * sigmoid(-zp)) if negative >= 0 else -g_neg
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, prior: float | None = None) -> Model:
    """A model from the rows of docs whose fold is not 0; labels: (doc_id, toxic). prior: share of toxic texts, by default
    that of the labels learnt from. Without a positive example no word has weight and every text scores under 0.5."""
    learnt = fold(F.col("doc_id"), folds) != 0
    known = labels.where(learnt & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if prior is None:
        prior = min(0.5, max(0.01, (toxic or 0) / total)) if total else 0.05
    first = lambda rows, n: rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = first(known.where("toxic = 1").select("doc_id"), POSITIVES).withColumn("positive", F.lit(1))
    every = first(docs.where(learnt & F.col("doc_id").isNotNull()).select("doc_id"), UNLABELLED).withColumn("unlabelled", F.lit(1))
    chosen = positive.join(every, "doc_id", "full")
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("positive", "unlabelled")]))
    n_pos, n_unl = sample.agg(F.sum("positive"), F.sum("unlabelled")).first()
    if not n_pos or not n_unl:
        return Model(float(np.log(min(prior, 0.4) / (1 - min(prior, 0.4)))))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, p, u) for t, p, u in zip(b["text"], b["positive"], b["unlabelled"], strict=True) for w in features(t)]
            yield pd.DataFrame(rows, columns=["word", "p", "u"]).groupby("word", as_index=False).sum()

    counts = sample.mapInPandas(seen, "word binary, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share, base = (F.col("p") + 0.5) / (n_pos + 1), (F.col("u") + 0.5) / (n_unl + 1)
    z = (share - base) / F.sqrt(base * (1 - base) * (1 / n_pos + 1 / n_unl) + 1e-12)
    words = [bytes(r.word) for r in counts.where(F.col("p") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy("word").collect()]
    number = {w: k for k, w in enumerate(words)}

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = _Hits(number)
        for b in batches:
            yield pd.DataFrame({"positive": b["positive"], "unlabelled": b["unlabelled"], "has": [sorted(set().union(*map(hits.__getitem__, set(plain_words(t))))) for t in b["text"]]})

    # At most POSITIVES + UNLABELLED documents (repeated rows are equal and counted); of their features only significant ones.
    rows = sample.mapInPandas(presence, "positive int, unlabelled int, has array<int>").groupBy("positive", "unlabelled", "has").count().orderBy("has", "positive", "unlabelled").collect()
    discard(sample)
    times = [r["count"] for r in rows]
    table = lambda c: Sparse([r.has for r in rows if r[c]], len(words))
    often = lambda c: np.array([n for r, n in zip(rows, times, strict=True) if r[c]], float)
    weights, bias = train(table("positive"), table("unlabelled"), prior, often("positive"), often("unlabelled"))
    return Model(bias, {w: float(x) for w, x in zip(words, weights, strict=True)})


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; null and empty texts score by the bias alone, repeated rows alike. A column named `out`
    is replaced, all others stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, run(F.col("text")))
