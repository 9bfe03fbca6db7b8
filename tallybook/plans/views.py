"""The views that queries start from, in Spark and, with the same meaning, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import catalog, index
from tallybook.sources import tables

LINES = "string_split(text, chr(10))"
TERMS = r"regexp_extract_all(replace(lower(strip_accents({})), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def obs(spark: SparkSession, d: str) -> DataFrame:
    return tables.sightings(tables.table(spark, d, "events"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.documents(tables.table(spark, d, "documents"))


def counted(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_counts(docs(spark, d), catalog.counters(obs(spark, d)))


def ranked(spark: SparkSession, d: str, sort: str | None = None) -> DataFrame:
    """What ranking needs of the documents; names are cut from texts only where they are the sort."""
    more = [sort] if sort in ("name", "size", "file_count") else []
    return tables.with_counts(docs(spark, d).select("doc_id", "info_hash", *more), catalog.counters(obs(spark, d)))


def stored_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(postings, typos) as they are stored, built if these documents have none yet."""
    return index.stored(docs(spark, d), tables.fingerprint(tables.table(spark, d, "documents")))


def posted(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d)[0]


def typos(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d)[1]


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries with states made up from their key and counters."""
    rows = obs(spark, d)
    more = rows.groupBy("key").agg(F.countDistinct("peer").alias("peers"), F.min("seq").alias("seq"), F.max("seq").alias("touched"))
    state = F.when(F.col("seen_count") % 4 == 0, "done").otherwise("pending")
    found = catalog.counters(rows).join(more, "key").withColumns({"fetch_state": state, "checked": F.col("key") % 5 != 0, "lookups": F.col("key") % 3, "looking": F.col("key") % 7 == 0})
    found = found.withColumn("peers", F.when(F.col("key") % 11 < 6, F.col("peers")).otherwise(F.lit(0)))
    queue = catalog.queue_of(F.col("fetch_state"), F.col("checked"), F.col("peers"), F.col("looking"), F.col("lookups"))
    return found.withColumns({"queue": queue, "next_lookup_time": catalog.next_time(F.col("first_seen"), F.col("lookups")), "has_metadata": F.col("fetch_state") == "done", "evictable": catalog.is_evictable(F.col("fetch_state"), F.col("looking"))})


OBS = """obs AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'purchase' THEN 'announce_peer' WHEN event_type IN ('view', 'click') THEN 'get_peers' ELSE 'sample' END AS source,
  epoch(ts) AS moment, CASE WHEN event_type = 'purchase' THEN json_extract_string(props, '$.k')::BIGINT END AS peer FROM events)"""
COUNTS = """counts AS (SELECT key, count(*) AS seen_count, count(*) FILTER (source = 'announce_peer') AS announce_count, arg_min(moment, seq) AS first_seen, max(moment) AS last_seen FROM obs GROUP BY key)"""
DOCS = f"""docs AS (SELECT doc_id, sha1(doc_id::VARCHAR) AS info_hash, {LINES}[1] AS name, {LINES}[2:] AS paths, n_chars AS size, greatest(1, len({LINES}) - 1)::BIGINT AS file_count FROM documents)"""
CAT = """cat AS (SELECT d.* EXCLUDE (dealt), coalesce(c.seen_count, 0)::BIGINT AS seen_count, coalesce(c.announce_count, 0)::BIGINT AS announce_count, coalesce(c.first_seen, 0.0) AS first_seen, coalesce(c.last_seen, 0.0) AS last_seen
  FROM (SELECT *, doc_id % (SELECT max(key) + 1 FROM counts) AS dealt FROM docs) d LEFT JOIN counts c ON c.key = d.dealt)"""
POSTED = f"""posted AS (SELECT doc_id, unnest(list_distinct({TERMS.format("name")})) AS term, true AS in_name FROM docs
  UNION ALL SELECT doc_id, unnest(list_distinct({TERMS.format("array_to_string(paths[1:20], chr(10))")})), false FROM docs)"""
VOCABULARY = "vocabulary AS (SELECT DISTINCT term FROM posted WHERE length(term) BETWEEN 3 AND 32)"
TYPOS = """typos AS (SELECT term AS variant, term FROM vocabulary UNION SELECT concat(substr(term, 1, i - 1), substr(term, i + 1)), term FROM vocabulary, LATERAL unnest(range(1, length(term) + 1)) u(i))"""
ENTRIES = """more AS (SELECT key, count(DISTINCT peer) AS p, min(seq) AS seq, max(seq) AS touched FROM obs GROUP BY key),
e0 AS (SELECT *, CASE WHEN seen_count % 4 = 0 THEN 'done' ELSE 'pending' END AS fetch_state, key % 5 <> 0 AS checked, key % 3 AS lookups, key % 7 = 0 AS looking, CASE WHEN key % 11 < 6 THEN p ELSE 0 END AS peers FROM counts JOIN more USING (key)),
entries AS (SELECT *, CASE WHEN fetch_state = 'pending' AND NOT checked THEN 'needs_check' WHEN fetch_state = 'pending' AND peers > 0 THEN 'fetchable'
  WHEN fetch_state = 'pending' AND NOT looking AND lookups < 2 THEN 'needs_lookup' END AS queue, first_seen + 30.0 * lookups AS next_lookup_time, fetch_state = 'done' AS has_metadata, NOT looking AS evictable FROM e0)"""

_PARTS = {"obs": OBS, "counts": COUNTS, "docs": DOCS, "cat": CAT, "posted": POSTED, "vocabulary": VOCABULARY, "typos": TYPOS, "entries": ENTRIES}
_NEEDS = {"counts": ["obs"], "cat": ["docs", "counts"], "posted": ["docs"], "vocabulary": ["posted"], "typos": ["vocabulary"], "entries": ["counts"]}


def sql(body: str, *views: str) -> str:
    """A statement with the views it needs before it."""
    order: list[str] = []

    def need(v: str) -> None:
        for n in _NEEDS.get(v, []):
            need(n)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    body = body.strip()
    start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
    head = ",\n".join(_PARTS[v] for v in order)
    return f"{start}{head},\n{body.removeprefix(start)}" if start else f"WITH {head}\n{body}" if order else body
