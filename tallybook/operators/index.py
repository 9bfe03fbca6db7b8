"""Index tables derived from documents (A17, D7, H2, H4): postings, vocabulary, typo index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import text
from tallybook.session import shared_dir


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, in_name): a row for every distinct term of a document's name and of its searchable files.

    Terms are made distinct within the row they come from, so building the index shuffles nothing.
    """
    tagged = lambda source, flag: F.transform(F.array_distinct(text.terms(source)), lambda t: F.struct(t.alias("term"), F.lit(flag).alias("in_name")))
    both = F.concat(tagged(F.col("name"), True), tagged(text.files_text(F.col("paths")), False))
    return docs.select("doc_id", F.explode(both).alias("p")).select("p.term", "doc_id", "p.in_name")


def vocabulary(posted: DataFrame) -> DataFrame:
    """Distinct terms that are long and short enough for typos."""
    return posted.where(text.is_indexed(F.col("term"))).select("term").distinct()


def typo_index(terms: DataFrame) -> DataFrame:
    """H4: (variant, term) of every term and its deletions."""
    return terms.select(F.explode(text.variants(F.col("term"))).alias("variant"), "term")


def write(docs: DataFrame, path: str) -> None:
    """Postings sorted by term within files, so that a term's predicate skips row groups; typo index by variant, for terms
    that may be typos. The mark is written last: an index without it isn't read."""
    spark = docs.sparkSession
    # A range is found by reading its input once more; texts are cut into terms only once.
    postings(docs).write.mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    raw.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    spark.createDataFrame([], raw.schema).write.mode("overwrite").parquet(f"{path}/raw")
    words = vocabulary(spark.read.parquet(f"{path}/postings"))
    words.write.mode("overwrite").parquet(f"{path}/words")
    typo_index(spark.read.parquet(f"{path}/words")).repartitionByRange("variant").sortWithinPartitions("variant").write.mode("overwrite").parquet(f"{path}/typos")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(postings, typos) of a finished index, or None."""
    try:
        spark.read.parquet(f"{path}/done")
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/typos")


def stored(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(postings, typos) of documents, from the shared folder; built when there is no index of that name yet. The name must change
    with the documents (see tables.fingerprint)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index-{name}"
    found = read(spark, path)
    if found is None:
        write(docs, path)
        found = read(spark, path)
    return found
