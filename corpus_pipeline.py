"""Corpus pipeline over documents: five stages, each a decision of one operator of tallybook.llm.

Every stage takes what its predecessor kept and returns the columns of documents (the last: tokens in place of texts).
Rows with a null text are empty texts. Rows are judged by their texts, also where doc_id is null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, contain, nearcopies, secrets, toxicity
from tallybook.llm.common import fresh, materialize
from tallybook.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic (0.5 or more) go."""
    [score] = fresh(docs, "_toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (0.8 or more of their five-word shingles shared) the row with the smallest id stays, once."""
    return nearcopies.kept_rows(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 or more of its five-word shingles) go."""
    return contain.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials are replaced by a mark; the documents stay, n_chars is the new length."""
    [spans] = fresh(docs, "_spans")
    text = secrets.redacted(F.coalesce("text", F.lit("")), F.col(spans))
    found = secrets.with_spans(docs, out=spans).withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with the digests of its tokens and of what they decode to."""
    return bpe.encoded(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; a test compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
