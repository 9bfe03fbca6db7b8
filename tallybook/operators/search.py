"""Two-tier ranked search.

A query's terms, their prefix form (last term) and their typo alternatives form a probe of a few hundred rows at most. One
aggregate over the matching postings tells for each document whether all terms hit exactly or by an alternative, anywhere or
in the name; tiers, the name-first order and the limit then are one sort with a limit.

Ranking reads slim rows (key, counters, a sort column); the documents of the page alone are fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions import text

SEARCH_COLUMNS = ("info_hash", "name", "size", "file_count", "seen_count", "announce_count", "first_seen", "last_seen")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def order_by(sort: str | None = None, desc: bool = True) -> list[Column]:
    """rank by sightings, then latest; a sort column goes first, all in one direction; names ignore ASCII case."""
    way = F.asc if sort and not desc else F.desc
    ranks = dict.fromkeys([sort, "seen_count", "last_seen"] if sort else ["seen_count", "last_seen"])
    plain = {"name": F.translate("name", UPPER, LOWER)}
    return [*(way(plain.get(c, F.col(c))) for c in ranks), F.asc("info_hash")]


def _page(ranked: DataFrame, order: list[Column], limit: int, docs: DataFrame | None) -> DataFrame:
    """The first rows in order, with what the documents add to them; at most `limit` rows are broadcast."""
    if docs is None:
        return ranked.orderBy(*order).limit(limit).select(*SEARCH_COLUMNS)
    top = ranked.orderBy(*order).limit(limit)
    more = [c for c in SEARCH_COLUMNS if c not in top.columns]
    return docs.select("doc_id", *more).join(F.broadcast(top), "doc_id").orderBy(*order).select(*SEARCH_COLUMNS)


def scan(ranked: DataFrame, limit: int, sort: str | None = None, desc: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """A5: all documents in order, a page of them. With `docs`, ranked needs doc_id, the counters and the sort column only."""
    return _page(ranked, order_by(sort, desc), limit, docs)


def scan_memory(docs: DataFrame, query: str, limit: int, sort: str | None = None, desc: bool = True) -> DataFrame:
    """Substring search over name and all listed paths; names sort by Unicode lower case."""
    needle = query.strip().lower()
    found = docs.where(F.contains(text.search_text(F.col("name"), F.col("paths")), F.lit(needle))) if needle else docs
    keys = [F.lower("name") if sort == "name" else F.col(sort)] if sort else []
    keys += [F.col("seen_count"), F.col("last_seen")]
    desc = desc if sort else True
    return found.select(*SEARCH_COLUMNS).orderBy(*[k.desc() if desc else k.asc() for k in keys], "info_hash").limit(limit)


def alternatives(spark: SparkSession, terms: list[str], typos: DataFrame) -> DataFrame:
    """(pos, term) of words of the vocabulary one edit away from a query term, the first twenty of each.

    Both sides meet on a shared deletion, so this is an equi-join with a probe of a few hundred rows. The probe's least and
    greatest variants bound what is read of a stored index, which is sorted by them.
    """
    asked = [(k, t, v) for k, t in enumerate(terms) if len(t) >= text.MIN_TYPO for v in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}]
    probe = spark.createDataFrame(asked, "pos int, asked string, variant string").where(text.may_be_typo(F.col("asked")))
    # One edit changes a length by one at most; this filter reaches below the making of variants, where they aren't stored.
    sizes = [len(t) for _, t, _ in asked] or [-1]
    likely = typos.where(F.char_length("term").between(min(sizes) - 1, max(sizes) + 1) & F.col("variant").between(min((v for *_, v in asked), default=""), max((v for *_, v in asked), default="")))
    near = likely.join(F.broadcast(probe), "variant").where(F.col("term") != F.col("asked")).select("pos", "asked", "term").distinct()
    near = near.where(text.within_one_edit(F.col("term"), F.col("asked")))
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("pos").orderBy("term"))).where(F.col("_n") <= text.MAX_ALTERNATIVES).select("pos", "term")


def matches(posted: DataFrame, terms: list[str], more: DataFrame | None = None) -> DataFrame:
    """(doc_id, exact, name_exact, any, name_any): whether every term hits, only the last as a prefix; alternatives are
    whole words. Without `more` the exact tier alone is computed, with a predicate that the scan can use."""
    n = len(terms)
    word, last = F.col("term"), terms[-1]
    hit = lambda k: word.startswith(terms[k]) if k == n - 1 else word == terms[k]
    places = F.filter(F.array(*[F.when(hit(k), F.lit(k)) for k in range(n)]), lambda x: x.isNotNull())
    literal = word.isin(terms[:-1]) | word.startswith(last) if n > 1 else word.startswith(last)
    rows = posted.where(literal).select("doc_id", "in_name", F.explode(places).alias("pos"), F.lit(True).alias("exact"))
    if more is not None:
        rows = rows.unionByName(posted.join(F.broadcast(more), "term").select("doc_id", "in_name", "pos", F.lit(False).alias("exact")))
    bit = F.expr("shiftleft(1, pos)")
    mask = lambda when: F.coalesce(F.bit_or(F.when(when, bit)), F.lit(0)) == (1 << n) - 1
    every = F.lit(True)
    return (
        rows.groupBy("doc_id")
        .agg(mask(F.col("exact")).alias("exact"), mask(F.col("exact") & F.col("in_name")).alias("name_exact"), mask(every).alias("any"), mask(F.col("in_name")).alias("name_any"))
        .where("any")
    )


def search(ranked: DataFrame, posted: DataFrame, typos: DataFrame, query: str, limit: int = 20, sort: str | None = None, desc: bool = True, typo_tier: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """The search: documents with all terms, name matches first, then those that match with typos allowed.

    With a sort, the wider match replaces the exact one if that fills less than the limit, and only the sort counts.
    A query without terms is a scan. With `docs`, ranked needs doc_id, info_hash, the counters and the sort column only.
    """
    terms = text.query_terms(query)
    if not terms:
        return scan(ranked, limit, sort, desc, docs)
    more = alternatives(ranked.sparkSession, terms, typos) if typo_tier else None
    hits = matches(posted, terms, more)
    found = ranked.join(hits, "doc_id")
    tier = F.when(F.col("exact"), 0).otherwise(1).alias("tier")
    in_name = F.when(F.col("exact"), F.col("name_exact")).otherwise(F.col("name_any")).alias("in_name")
    found = found.select(*ranked.columns, "exact", tier, in_name)
    if sort and typo_tier:
        full = hits.where("exact").limit(limit).agg(F.count("*").alias("_full"))
        found = found.crossJoin(F.broadcast(full)).where(F.col("exact") | (F.col("_full") < limit)).drop("_full")
    first = [] if sort else [F.asc("tier"), F.desc("in_name")]
    return _page(found, [*first, *order_by(sort, desc)], limit, docs)
