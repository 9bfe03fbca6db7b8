
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import address, codecs, display, text
from tallybook.operators import catalog, crawl, datagrams, fetching, flushing, index, nearest, search, stateful, stats, store
from tallybook.plans.views import TERMS, counted, docs, entries, obs, posted, ranked, sql, stored_index, typos
from tallybook.session import shared_dir
from tallybook.sources.tables import epoch, table
from tallybook.streaming import catalog as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


COLUMNS = ", ".join(search.SEARCH_COLUMNS)

# Scans and lookups


@register("scan_rank_order", sql(f"SELECT {COLUMNS} FROM cat ORDER BY seen_count DESC, last_seen DESC, info_hash LIMIT 50", "cat"))
def scan_rank_order(spark: SparkSession, d: str) -> DataFrame:
    """A5, F1, B1"""
    return search.scan(ranked(spark, d), 50, docs=docs(spark, d))


@register("point_lookup", sql("SELECT doc_id, info_hash, name, size, file_count FROM docs WHERE info_hash = sha1('7')", "docs"))
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return store.document(docs(spark, d), "902ba3cda1883801594b6e1b452790cc53948fda").drop("paths")


@register("in_list_lookup", sql("SELECT info_hash, seen_count, announce_count FROM cat WHERE info_hash IN (SELECT sha1((item_id * 3)::VARCHAR) FROM benchmark)", "cat"))
def in_list_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A7"""
    keys = table(spark, d, "benchmark").select(F.sha1((F.col("item_id") * 3).cast("string")).alias("info_hash"))
    return store.lookup(counted(spark, d), keys).select("info_hash", "seen_count", "announce_count")


@register("count_documents", "SELECT count(*)::BIGINT AS documents FROM documents")
def count_documents(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    return table(spark, d, "documents").agg(F.count("*").alias("documents"))


@register("totals", "SELECT count(*)::BIGINT AS documents, sum(n_chars::DOUBLE) AS size, max(doc_id) AS last_id FROM documents")
def totals(spark: SparkSession, d: str) -> DataFrame:
    """A11"""
    return store.totals(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size")))


# Text and index


@register("text_terms", f"SELECT doc_id, term, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term")
def text_terms(spark: SparkSession, d: str) -> DataFrame:
    """H1"""
    return table(spark, d, "documents").select("doc_id", F.explode(text.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@register("text_terms_exact", ORACLES["text_terms"].replace("doc_id, term, count(*)::BIGINT AS n", "term, count(*)::BIGINT AS n").replace("GROUP BY doc_id, term", "GROUP BY term"))
def text_terms_exact(spark: SparkSession, d: str) -> DataFrame:
    """H1 by the function for all scripts"""
    return table(spark, d, "documents").select(F.explode(text.terms_exact(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register("search_text_contains", sql(f"SELECT {COLUMNS} FROM cat WHERE contains(lower(name || chr(10) || array_to_string(paths[1:200], chr(10))), 'thtion') ORDER BY seen_count DESC, last_seen DESC, info_hash LIMIT 50", "cat"))
def search_text_contains(spark: SparkSession, d: str) -> DataFrame:
    """A12, B2, F2, H10"""
    return search.scan_memory(counted(spark, d), " ThTion ", 50)


@register("index_build", sql("SELECT 'postings' AS part, count(*)::BIGINT AS entries, count(DISTINCT term)::BIGINT AS terms FROM posted UNION ALL SELECT 'typos', count(*), count(DISTINCT term) FROM typos", "typos"))
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The index written anew and counted as it was written; searches read a stored one"""
    path = f"{shared_dir(spark)}/index-build"
    index.write(docs(spark, d), path)
    parts = dict(zip(("postings", "typos"), index.read(spark, path), strict=True))
    count = lambda name: parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("entries"), F.countDistinct("term").alias("terms"))
    return count("postings").unionByName(count("typos"))


_FOREIGN = {
    "Việt Nam": ["viet", "nam"], "ｆｕｌｌ Ｗｉｄｔｈ１２": ["full", "width12"], "ﬁle ﬂow": ["file", "flow"], "Ελλάδα Ἀθῆναι": ["ελλαδα", "αθηναι"], "e\u0301te\u0301 nai\u0308ve": ["ete", "naive"],
    "ΣΊΣΥΦΟΣ": ["σισυφοσ"], "Москва Ёлка": ["москва", "елка"], "½ x² ªº": ["1", "2", "x2", "ao"], "東京 한국": ["東京", "한국"], "STRASSE Straße": ["strasse", "strasse"], "a_b don’t": ["a", "b", "don", "t"],
}


def _foreign_sql() -> str:
    import unicodedata

    said = ", ".join(f"({k}, [{', '.join(repr(unicodedata.normalize('NFKD', t)) for t in found)}])" for k, found in enumerate(_FOREIGN.values()))
    return f"WITH s(k, terms) AS (VALUES {said}) SELECT doc_id, unnest(terms) AS term FROM documents JOIN s ON k = doc_id % {len(_FOREIGN)}"


@register("text_terms_any_script", _foreign_sql())
def text_terms_any_script(spark: SparkSession, d: str) -> DataFrame:
    """H1: wide, decomposed, ligature and non-Latin texts by turns, against terms that are written out"""
    said = F.element_at(F.array(*[F.lit(t) for t in _FOREIGN]), (F.col("doc_id") % len(_FOREIGN) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.explode(text.terms(said)).alias("term"))


@register("vocabulary", sql("SELECT term FROM vocabulary", "vocabulary"))
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """D7"""
    return index.vocabulary(posted(spark, d))


@register("postings", sql("SELECT term, count(DISTINCT doc_id)::BIGINT AS documents, count(*) FILTER (in_name)::BIGINT AS names FROM posted GROUP BY term", "posted"))
def postings(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    return posted(spark, d).groupBy("term").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.when(F.col("in_name"), 1)).alias("names"))


@register("deletion_variants", sql("SELECT length(variant)::INT AS length, count(*)::BIGINT AS entries, count(DISTINCT term)::BIGINT AS terms FROM typos GROUP BY 1", "typos"))
def deletion_variants(spark: SparkSession, d: str) -> DataFrame:
    """H2, H4"""
    return typos(spark, d).groupBy(F.char_length("variant").alias("length")).agg(F.count("*").alias("entries"), F.countDistinct("term").alias("terms"))


_ASKED = f"""WITH asked AS (SELECT DISTINCT unnest({TERMS.format("text")}) AS asked FROM benchmark),
a AS (SELECT asked FROM asked WHERE length(asked) >= 4 AND NOT regexp_matches(asked, '^\\p{{N}}+$')),
av AS (SELECT asked AS variant, asked FROM a UNION SELECT concat(substr(asked, 1, i - 1), substr(asked, i + 1)), asked FROM a, LATERAL unnest(range(1, length(asked) + 1)) u(i))
SELECT DISTINCT asked, term FROM av JOIN typos USING (variant) WHERE damerau_levenshtein(asked, term) <= 1 AND asked <> term"""


@register("one_edit_pairs", sql(_ASKED, "typos"))
def one_edit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark and words of the documents one edit apart"""
    asked = table(spark, d, "benchmark").select(F.explode(text.terms(F.col("text"))).alias("asked")).distinct().where(text.may_be_typo(F.col("asked")))
    probe = asked.select("asked", F.explode(text.variants(F.col("asked"))).alias("variant"))
    pairs = typos(spark, d).join(probe, "variant").where("asked <> term").select("asked", "term").distinct()
    return pairs.where(text.within_one_edit(F.col("asked"), F.col("term")))


# Search


def _search_sql(query: str, limit: int, sort: str | None = None, desc: bool = True, typos: bool = True) -> str:
    terms = text.query_terms(query)
    n = len(terms)
    rows = ", ".join(f"({k}, '{t}')" for k, t in enumerate(terms))
    way = "DESC" if desc or not sort else "ASC"
    key = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if sort == "name" else sort
    order = ", ".join(f"{k} {way}" for k in [*([key] if sort else []), *[c for c in ("seen_count", "last_seen") if c != sort]]) + ", info_hash"
    wide = """UNION ALL SELECT doc_id, in_name, pos, false FROM posted JOIN alt USING (term)""" if typos else ""
    full = f"AND (exact OR (SELECT count(*) FROM hits WHERE exact) < {limit})" if sort and typos else ""
    return sql(
        f"""WITH q(pos, asked) AS (VALUES {rows}),
qv AS (SELECT pos, asked, asked AS variant FROM q UNION SELECT pos, asked, concat(substr(asked, 1, i - 1), substr(asked, i + 1)) FROM q, LATERAL unnest(range(1, length(asked) + 1)) u(i)),
alt AS (SELECT pos, term FROM (SELECT DISTINCT pos, asked, term FROM qv JOIN typos USING (variant) WHERE length(asked) >= 4 AND NOT regexp_matches(asked, '^[0-9]+$') AND asked <> term AND damerau_levenshtein(asked, term) <= 1)
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY term) <= 20),
r AS (SELECT doc_id, in_name, pos, true AS exact FROM posted JOIN q ON term = asked OR (pos = {n - 1} AND starts_with(term, asked)) {wide}),
hits AS (SELECT doc_id, count(DISTINCT pos) FILTER (exact) = {n} AS exact, count(DISTINCT pos) FILTER (exact AND in_name) = {n} AS name_exact, count(DISTINCT pos) FILTER (in_name) = {n} AS name_any FROM r GROUP BY doc_id HAVING count(DISTINCT pos) = {n})
SELECT {COLUMNS} FROM cat JOIN hits USING (doc_id) WHERE true {full} ORDER BY {"" if sort else "CASE WHEN exact THEN 0 ELSE 1 END, (CASE WHEN exact THEN name_exact ELSE name_any END) DESC, "}{order} LIMIT {limit}""",
        "cat",
        "typos",
    )


def _search(name: str, query: str, limit: int, sort: str | None = None, desc: bool = True, wide: bool = True) -> None:
    @register(name, _search_sql(query, limit, sort, desc, wide))
    def run(spark: SparkSession, d: str) -> DataFrame:
        words, near = stored_index(spark, d)
        return search.search(ranked(spark, d, sort), words, near, query, limit, sort, desc, wide, docs(spark, d))


_search("search_and", "this that", 30, wide=False)  # G1, C1
_search("search_prefix_last", "with thtio", 30, wide=False)  # G4, B3
_search("search_name_first", "the", 40, wide=False)  # C3, G3
_search("search_typo_two_tier", "onthsh tiher", 60)  # F8, G2, G5, C4
_search("search_sorted_expanded", "onthsh thatt", 200, "size")  # replacement rule
for _sort in address.SORTS:
    for _order in ("asc", "desc"):
        _search(f"search_sort_{_sort}_{_order}", "that thti", 25, _sort, _order == "desc")


@register(
    "typo_alternatives",
    sql(
        """WITH q(pos, asked) AS (VALUES (0, 'thatt'), (1, 'tiher'), (2, '2024'), (3, 'the')),
qv AS (SELECT pos, asked, asked AS variant FROM q UNION SELECT pos, asked, concat(substr(asked, 1, i - 1), substr(asked, i + 1)) FROM q, LATERAL unnest(range(1, length(asked) + 1)) u(i))
SELECT pos, term FROM (SELECT DISTINCT pos, asked, term FROM qv JOIN typos USING (variant) WHERE length(asked) >= 4 AND NOT regexp_matches(asked, '^[0-9]+$') AND asked <> term AND damerau_levenshtein(asked, term) <= 1)
QUALIFY row_number() OVER (PARTITION BY pos ORDER BY term) <= 20""",
        "typos",
    ),
)
def typo_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """C2, A9, H5"""
    return search.alternatives(spark, ["thatt", "tiher", "2024", "the"], typos(spark, d))


# Catalog


@register("sighting_counters", sql("SELECT * FROM counts", "counts"))
def sighting_counters(spark: SparkSession, d: str) -> DataFrame:
    """D1"""
    return catalog.counters(obs(spark, d))


_PEERS = """WITH t AS (SELECT key, peer, max(seq) AS touched FROM obs WHERE peer IS NOT NULL GROUP BY key, peer),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY touched DESC) <= 32)
"""


@register("peers_recent_32", sql(_PEERS + "SELECT key, string_agg(peer::VARCHAR, ',' ORDER BY touched) AS peers FROM k GROUP BY key", "obs"))
def peers_recent_32(spark: SparkSession, d: str) -> DataFrame:
    """D6"""
    return catalog.recent_peers(obs(spark, d)).select("key", F.array_join("peers", ",").alias("peers"))


@register("latest_hint", sql("SELECT key, arg_max(source, seq) AS source, arg_max(moment, seq) AS moment FROM obs GROUP BY key", "obs"))
def latest_hint(spark: SparkSession, d: str) -> DataFrame:
    """C9, C10"""
    return catalog.latest(obs(spark, d), ["key"], ["source", "moment"], "seq")


@register("failed_peers", sql("SELECT DISTINCT key, peer FROM obs WHERE peer IS NOT NULL AND (key, peer) NOT IN (SELECT key, peer FROM obs WHERE peer IS NOT NULL AND seq % 3 = 0)", "obs"))
def failed_peers(spark: SparkSession, d: str) -> DataFrame:
    """C5, G6"""
    peers = obs(spark, d).where("peer is not null")
    return catalog.without_failed(peers.select("key", "peer").distinct(), peers.where("seq % 3 = 0"))


@register("state_counts", sql("SELECT fetch_state, count(*)::BIGINT AS entries FROM entries GROUP BY 1", "entries"))
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    """D2, D14"""
    return catalog.state_counts(entries(spark, d))


@register("queues", sql("SELECT queue, count(*)::BIGINT AS entries FROM entries GROUP BY 1", "entries"))
def queues(spark: SparkSession, d: str) -> DataFrame:
    """B13"""
    return entries(spark, d).groupBy("queue").agg(F.count("*").alias("entries"))


@register("fetchable_topk", sql("SELECT key, seen_count, last_seen FROM entries WHERE queue = 'fetchable' ORDER BY seen_count DESC, last_seen DESC, key LIMIT 10", "entries"))
def fetchable_topk(spark: SparkSession, d: str) -> DataFrame:
    """F4"""
    return catalog.fetch_candidates(entries(spark, d), 10).select("key", "seen_count", "last_seen")


@register("needs_lookup_newest", sql("SELECT key, touched FROM entries WHERE queue = 'needs_lookup' AND next_lookup_time <= 1704153600 ORDER BY touched DESC, key LIMIT 10", "entries"))
def needs_lookup_newest(spark: SparkSession, d: str) -> DataFrame:
    """F5, B14"""
    return catalog.lookups_due(entries(spark, d), 1704153600.0, 10).select("key", "touched")


@register(
    "database_gate",
    sql("SELECT e.key, CASE WHEN s.key IS NULL THEN e.fetch_state ELSE 'done' END AS fetch_state, s.seen_count AS base_seen FROM entries e LEFT JOIN (SELECT * FROM counts WHERE key % 2 = 0) s ON s.key = e.key", "entries"),
)
def database_gate(spark: SparkSession, d: str) -> DataFrame:
    """C6, I14"""
    return catalog.gate(entries(spark, d), catalog.counters(obs(spark, d)).where("key % 2 = 0")).select("key", "fetch_state", "base_seen")


@register(
    "cumulative_counters",
    sql(
        """WITH live AS (SELECT key, count(*) AS s, count(*) FILTER (source = 'announce_peer') AS a, arg_min(moment, seq) AS f, max(moment) AS l FROM obs WHERE seq % 2 = 1 GROUP BY key),
base AS (SELECT key, count(*) AS s, count(*) FILTER (source = 'announce_peer') AS a, arg_min(moment, seq) AS f FROM obs WHERE seq % 2 = 0 AND key % 3 = 0 GROUP BY key)
SELECT live.key, live.s + coalesce(base.s, 0) AS seen_count, live.a + coalesce(base.a, 0) AS announce_count, least(live.f, base.f) AS first_seen, live.l AS last_seen FROM live LEFT JOIN base USING (key)""",
        "obs",
    ),
)
def cumulative_counters(spark: SparkSession, d: str) -> DataFrame:
    """C13"""
    rows = obs(spark, d)
    return catalog.cumulative(catalog.counters(rows.where("seq % 2 = 1")), catalog.counters(rows.where("seq % 2 = 0 and key % 3 = 0")))


@register(
    "eviction_victims",
    sql(
        """WITH a AS (SELECT key FROM entries WHERE evictable AND NOT has_metadata AND seen_count <= 1 AND peers = 0 ORDER BY seq LIMIT 20),
b AS (SELECT key FROM entries WHERE evictable AND key NOT IN (SELECT key FROM a) ORDER BY has_metadata, peers > 0, seen_count, last_seen, seq LIMIT (SELECT 20 - count(*) FROM a))
SELECT key, 1 AS phase FROM a UNION ALL SELECT key, 2 FROM b""",
        "entries",
    ),
)
def eviction_victims(spark: SparkSession, d: str) -> DataFrame:
    """I8, F6, B12"""
    return catalog.eviction_victims(entries(spark, d), 400)


@register("recent_hashes_20", sql("SELECT key, max(seq) AS touched FROM obs GROUP BY key ORDER BY touched DESC LIMIT 20", "obs"))
def recent_hashes_20(spark: SparkSession, d: str) -> DataFrame:
    """F9, I7"""
    return catalog.bounded_queue(obs(spark, d).groupBy("key").agg(F.max("seq").alias("touched")), "touched", 20)


@register("backlog_bounded_queue", sql("SELECT seq, key FROM obs ORDER BY seq DESC LIMIT 500", "obs"))
def backlog_bounded_queue(spark: SparkSession, d: str) -> DataFrame:
    """I11"""
    return catalog.bounded_queue(obs(spark, d), "seq", 500).select("seq", "key")


@register("fifo_drain", sql("SELECT seq, key FROM obs WHERE source = 'sample' ORDER BY seq LIMIT 250", "obs"))
def fifo_drain(spark: SparkSession, d: str) -> DataFrame:
    """F7"""
    return catalog.oldest(obs(spark, d).where("source = 'sample'"), "seq", 250).select("seq", "key")


@register("lookup_start_budget", sql("SELECT key, greatest(0, least(512 - peers, lookups + 3, seen_count))::BIGINT AS budget FROM entries", "entries"))
def lookup_start_budget(spark: SparkSession, d: str) -> DataFrame:
    """I12"""
    return entries(spark, d).select("key", catalog.start_budget(F.col("peers"), F.col("lookups") + 3, F.col("seen_count")).cast("long").alias("budget"))


_MARKS = """WITH peers AS (SELECT DISTINCT key, '10.0.0.' || (peer % 50) AS ip, 1000 + peer AS port FROM obs WHERE peer IS NOT NULL),
marks AS (SELECT '10.0.0.' || (peer % 50) AS ip, CASE WHEN seq % 2 = 0 THEN 1000 + peer END AS port, moment + 600 AS expiry FROM obs WHERE peer IS NOT NULL AND seq % 5 = 0),
live AS (SELECT ip, port FROM marks GROUP BY ip, port HAVING max(expiry) > 1706000000)
SELECT key, ip, port FROM peers p WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.ip = p.ip AND (live.port IS NULL OR live.port = p.port))"""


@register("ttl_unreachable", sql(_MARKS, "obs"))
def ttl_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """I6, B15"""
    rows = obs(spark, d).where("peer is not null").withColumns({"ip": F.concat(F.lit("10.0.0."), F.col("peer") % 50), "port": F.col("peer") + 1000})
    marks = rows.where("seq % 5 = 0").select("ip", F.when(F.col("seq") % 2 == 0, F.col("port")).alias("port"), (F.col("moment") + 600).alias("expiry"))
    return catalog.reachable(rows.select("key", "ip", "port").distinct(), marks, 1706000000.0).select("key", "ip", "port")


@register("sample_backoff", sql("SELECT seq, moment + CASE WHEN source = 'sample' THEN 21600 ELSE greatest(0, least(coalesce(peer * 300, 0), 21600)) END AS ready FROM obs", "obs"))
def sample_backoff(spark: SparkSession, d: str) -> DataFrame:
    """I6, H50"""
    return obs(spark, d).select("seq", catalog.sample_backoff(F.col("moment"), F.col("peer") * 300, F.when(F.col("source") == "sample", 204)).alias("ready"))


# Store

_CHANGED = "c AS (SELECT info_hash, doc_id % 7 AS ds, doc_id % 3 AS da, doc_id / 10.0 AS f, doc_id + 1704067200.5 AS l FROM docs WHERE doc_id % 2 = 0)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).where("doc_id % 2 = 0")
    return rows.select(
        "info_hash", F.col("doc_id").alias("seq"), "name", "size", "file_count", (F.col("doc_id") % 7).alias("seen_count"), (F.col("doc_id") % 3).alias("announce_count"),
        (F.col("doc_id") / 10).alias("first_seen"), (F.col("doc_id") + 1704067200.5).alias("last_seen"),
    )


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).where("doc_id % 3 <> 0").select("info_hash", "name", "size", "file_count", *store.COUNTERS)


@register(
    "delta_upsert",
    sql(
        f"""WITH s AS (SELECT * FROM cat WHERE doc_id % 3 <> 0), {_CHANGED}
SELECT d.info_hash, d.name, d.size, d.file_count, coalesce(s.seen_count, 0) + coalesce(ds, 0) AS seen_count, coalesce(s.announce_count, 0) + coalesce(da, 0) AS announce_count, least(s.first_seen, f) AS first_seen, greatest(s.last_seen, l) AS last_seen
FROM docs d LEFT JOIN s USING (info_hash) LEFT JOIN c USING (info_hash) WHERE s.info_hash IS NOT NULL OR c.info_hash IS NOT NULL""",
        "cat",
    ),
)
def delta_upsert(spark: SparkSession, d: str) -> DataFrame:
    """E1, C7, D9"""
    return store.merged(_stored(spark, d), store.summed(_changes(spark, d)))


@register("previous_values", sql(f"WITH {_CHANGED} SELECT info_hash, cat.seen_count, cat.announce_count, cat.first_seen FROM c LEFT JOIN (SELECT * FROM cat WHERE doc_id % 3 <> 0) cat USING (info_hash)", "cat"))
def previous_values(spark: SparkSession, d: str) -> DataFrame:
    """D9"""
    return store.previous(_stored(spark, d), _changes(spark, d).drop("seq"))


@register(
    "counter_update",
    sql(f"WITH {_CHANGED} SELECT info_hash, seen_count + coalesce(ds, 0) AS seen_count, announce_count + coalesce(da, 0) AS announce_count, first_seen, greatest(last_seen, l) AS last_seen FROM cat LEFT JOIN c USING (info_hash) WHERE doc_id % 3 <> 0", "cat"),
)
def counter_update(spark: SparkSession, d: str) -> DataFrame:
    """E2"""
    return store.updated(_stored(spark, d), _changes(spark, d)).select("info_hash", *store.COUNTERS)


@register("counter_update_missing", sql("SELECT info_hash FROM docs WHERE doc_id % 2 = 0 AND doc_id % 3 = 0", "docs"))
def counter_update_missing(spark: SparkSession, d: str) -> DataFrame:
    """C8, E5"""
    return store.missing(_stored(spark, d), _changes(spark, d)).select("info_hash")


@register("pending_deltas", sql("SELECT info_hash, seen_count - seen_count // 2 AS seen_count, announce_count - announce_count // 2 AS announce_count, last_seen FROM cat WHERE doc_id % 4 <> 1 AND (seen_count - seen_count // 2 > 0 OR announce_count - announce_count // 2 > 0)", "cat"))
def pending_deltas(spark: SparkSession, d: str) -> DataFrame:
    """E3, E7"""
    rows = counted(spark, d)
    flushed = {f"flushed_{c}": F.floor(F.col(c) / 2) for c in store.COUNTERS[:2]}
    return store.pending(rows.withColumns(flushed | {"tracked": F.lit(True), "in_database": F.col("doc_id") % 4 != 1, "has_metadata": F.lit(False)}))


@register("totals_catch_up", "SELECT count(*)::BIGINT AS documents, sum(round(o_totalprice * 100)) / 100 AS size, max(o_orderkey) AS last_id FROM orders")
def totals_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the first orders, then caught up with the rest; cents are summed so that the order of sums is no matter"""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).alias("size"))
    half = rows.where(F.col("id") % 4294967296 <= 1000)
    return store.caught_up(store.totals(half), rows).withColumn("size", F.col("size") / 100)


@register("saturating_size", "SELECT l_orderkey, l_linenumber, least(l_orderkey::HUGEINT * 1000000000000000000, 9223372036854775807)::BIGINT AS size FROM lineitem")
def saturating_size(spark: SparkSession, d: str) -> DataFrame:
    """E6"""
    wide = F.col("l_orderkey").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", store.saturated(wide).alias("size"))


@register(
    "detail_coalesce",
    sql(
        """WITH a AS (SELECT info_hash, seen_count, 'pending' AS fetch_state, CASE WHEN doc_id % 4 = 0 THEN name END AS name FROM cat WHERE doc_id % 2 = 0),
b AS (SELECT info_hash, seen_count + 1 AS seen_count, 'done' AS fetch_state, name FROM cat WHERE doc_id % 3 = 0)
SELECT info_hash, CASE WHEN a.name IS NULL AND b.info_hash IS NOT NULL THEN 'stored' ELSE 'live' END AS source, CASE WHEN a.name IS NULL AND b.info_hash IS NOT NULL THEN b.seen_count ELSE a.seen_count END AS seen_count,
  CASE WHEN a.name IS NULL AND b.info_hash IS NOT NULL THEN b.fetch_state ELSE a.fetch_state END AS fetch_state, CASE WHEN a.name IS NULL AND b.info_hash IS NOT NULL THEN b.name ELSE a.name END AS name FROM a FULL JOIN b USING (info_hash)""",
        "cat",
    ),
)
def detail_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """C12, B4, B5"""
    rows = counted(spark, d)
    state = {"fetch_state": F.lit("pending"), "fetch_attempts": F.lit(0), "last_error": F.lit(""), "lookups_started": F.lit(0), "peers": F.lit(None).cast(f"array<{store.PEER}>"), "has_metadata": F.col("doc_id") % 4 == 0}
    live = store.live_detail(rows.where("doc_id % 2 = 0").withColumns(state))
    stored = store.stored_detail(rows.where("doc_id % 3 = 0").withColumn("seen_count", F.col("seen_count") + 1))
    return store.detail(live, stored).select("info_hash", "source", "seen_count", "fetch_state", "metadata.name")


# Scalars

_TR = display.LINK_END


@register("magnet_links", sql(f"SELECT info_hash, '{display.LINK_START}' || info_hash || CASE WHEN name <> '' THEN '&dn=' || url_encode(name) ELSE '' END || '{_TR}' AS link FROM docs", "docs"))
def magnet_links(spark: SparkSession, d: str) -> DataFrame:
    """H13, H14"""
    return docs(spark, d).select("info_hash", display.magnet_link(F.col("info_hash"), F.col("name")).alias("link"))


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber"))).cast("long").alias("n"))


_N = "n AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * pow(10.0, l_linenumber))::BIGINT AS n FROM lineitem)"
_DEC = "round((n::DOUBLE / {0})::DECIMAL(38,9), 1)::DECIMAL(38,1)"
_BYTES = "CASE WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN {_DEC.format(f'{1024**k}.0')} || ' {u}'" for k, u in enumerate(display.BYTE_UNITS) if 0 < k < 6) + f" ELSE {_DEC.format('1152921504606846976.0')} || ' EiB' END"
_COUNT = "CASE WHEN n < 1000 THEN n::VARCHAR " + " ".join(f"WHEN {_DEC.format(f'{1000**k}.0')} < 1000 THEN regexp_replace({_DEC.format(f'{1000**k}.0')}::VARCHAR, '[.]0$', '') || '{u}'" for k, u in enumerate(display.COUNT_UNITS) if 0 < k < 4) + f" ELSE regexp_replace({_DEC.format('1000000000000.0')}::VARCHAR, '[.]0$', '') || 'T' END"


@register("format_bytes", f"WITH {_N} SELECT l_orderkey, l_linenumber, {_BYTES} AS shown FROM n")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    """H20"""
    return _scaled(spark, d).select("l_orderkey", "l_linenumber", display.format_bytes(F.col("n")).alias("shown"))


@register("format_count", f"WITH {_N} SELECT l_orderkey, l_linenumber, {_COUNT} AS shown FROM n")
def format_count(spark: SparkSession, d: str) -> DataFrame:
    """H21, H25"""
    return _scaled(spark, d).select("l_orderkey", "l_linenumber", display.format_count(F.col("n")).alias("shown"))


@register("format_full", f"WITH {_N} SELECT l_orderkey, l_linenumber, replace(format('{{:,}}', n), ',', ' ') AS shown FROM n")
def format_full(spark: SparkSession, d: str) -> DataFrame:
    """H22"""
    return _scaled(spark, d).select("l_orderkey", "l_linenumber", display.format_full(F.col("n")).alias("shown"))


@register(
    "format_duration",
    """WITH s AS (SELECT event_id, round(value * 1000)::BIGINT AS s FROM events), p AS (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m FROM s)
SELECT event_id, CASE WHEN d > 0 THEN d || 'd ' ELSE '' END || CASE WHEN d > 0 OR h > 0 THEN h || 'h ' ELSE '' END || CASE WHEN d > 0 OR h > 0 OR m > 0 THEN m || 'm ' ELSE '' END || (s % 60) || 's' AS shown FROM p""",
)
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    """H23"""
    return table(spark, d, "events").select("event_id", display.format_duration(F.round(F.col("value") * 1000)).alias("shown"))


@register("format_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS shown FROM events")
def format_time(spark: SparkSession, d: str) -> DataFrame:
    """H24, in UTC"""
    seconds = F.pmod(F.floor(epoch("ts")), F.lit(86400))
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return table(spark, d, "events").select("event_id", F.concat_ws(":", part(seconds / 3600), part(seconds % 3600 / 60), part(seconds % 60)).alias("shown"))


_IP = "(c_custkey * 7919 % 256) || '.' || (c_custkey * 31 % 256) || '.' || (c_custkey % 256) || '.' || (c_custkey % 251)"
_NUMBER = "(c_custkey * 7919 % 256) * 16777216 + (c_custkey * 31 % 256) * 65536 + (c_custkey % 256) * 256 + c_custkey % 251"


def _special() -> str:
    import ipaddress

    return " OR ".join(f"n BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in map(ipaddress.ip_network, address.SPECIAL4))


@register("routable_ipv4", f"WITH a AS (SELECT c_custkey, {_IP} AS ip, {_NUMBER} AS n, c_custkey * 37 % 70000 AS port FROM customer) SELECT c_custkey, ip, port, port BETWEEN 1 AND 65535 AND NOT ({_special()}) AS routable FROM a")
def routable_ipv4(spark: SparkSession, d: str) -> DataFrame:
    """B7, B9"""
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"{_IP} AS ip", "c_custkey * 37 % 70000 AS port")
    return rows.withColumn("routable", address.is_routable_ip4(F.col("ip"), F.col("port")))


@register("routable_ipv6", "SELECT s_suppkey, s_suppkey % 4 = 0 AS routable FROM supplier")
def routable_ipv6(spark: SparkSession, d: str) -> DataFrame:
    """One global and three special prefixes by turns"""
    start = F.element_at(F.array(*[F.lit(x) for x in ("2a00:1450:", "2001:db8:", "fe80:0:", "ff02:0:")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(start, F.lit(":"), F.lower(F.hex(F.col("s_suppkey") % 60000 + 1))).alias("ip"))
    return rows.select("s_suppkey", address.is_routable(F.col("ip"), F.lit(6881)).alias("routable"))


@register("announced_port", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 6881 WHEN event_id % 70000 BETWEEN 1 AND 65535 THEN event_id % 70000 END::BIGINT AS port FROM events")
def announced_port(spark: SparkSession, d: str) -> DataFrame:
    """B18"""
    return table(spark, d, "events").select("event_id", address.announced_port(F.col("event_id") % 3, F.lit(6881).cast("long"), F.col("event_id") % 70000).alias("port"))


_XOR = ", ".join(f"xor(('0x' || substr(node_id, {8 * k + 1}, 8))::BIGINT, ('0x' || substr(sha1('target'), {8 * k + 1}, 8))::BIGINT)" for k in range(5))


@register("xor_nearest_k", f"WITH n AS (SELECT c_custkey AS seq, sha1(c_custkey::VARCHAR) AS node_id FROM customer) SELECT seq, node_id FROM n ORDER BY {_XOR}, seq LIMIT 8")
def xor_nearest_k(spark: SparkSession, d: str) -> DataFrame:
    """F3, C11, H40"""
    import hashlib

    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.sha1(F.col("c_custkey").cast("string")).alias("node_id"))
    return nearest.nearest(nodes, hashlib.sha1(b"target").hexdigest(), 8).select("seq", "node_id")


@register(
    "shortlist_32",
    f"""WITH n AS (SELECT sha1(o_custkey::VARCHAR) AS node_id, arg_max(o_orderkey, o_orderkey) AS seq FROM orders GROUP BY o_custkey)
SELECT seq, node_id FROM n WHERE seq % 5 <> 0 ORDER BY {_XOR}, seq LIMIT 32""",
)
def shortlist_32(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    import hashlib

    rows = table(spark, d, "orders").select(F.sha1(F.col("o_custkey").cast("string")).alias("node_id"), F.col("o_orderkey").cast("string").alias("ip"), F.lit(1).alias("port"), F.col("o_orderkey").alias("seq"))
    return nearest.shortlist(rows, rows.where("seq % 5 = 0"), hashlib.sha1(b"target").hexdigest()).select("seq", "node_id")


@register("sorted_peers", "SELECT o_custkey AS lookup, string_agg(DISTINCT o_orderpriority || ':' || o_orderstatus, ',' ORDER BY o_orderpriority || ':' || o_orderstatus) AS peers FROM orders GROUP BY 1")
def sorted_peers(spark: SparkSession, d: str) -> DataFrame:
    """F10"""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("lookup"), F.col("o_orderpriority").alias("ip"), F.col("o_orderstatus").alias("port"))
    return nearest.peers_found(rows).select("lookup", F.array_join(F.transform("peers", lambda p: F.concat_ws(":", p["ip"], p["port"])), ",").alias("peers"))


@register("neighbor_id", "SELECT c_custkey, substr(sha1(c_custkey::VARCHAR), 1, 30) || substr(sha1('own'), 31) AS id FROM customer")
def neighbor_id(spark: SparkSession, d: str) -> DataFrame:
    """H39"""
    joined = codecs.neighbor_id(F.unhex(F.sha1(F.col("c_custkey").cast("string"))), F.unhex(F.sha1(F.lit("own"))))
    return table(spark, d, "customer").select("c_custkey", display.hex_text(joined).alias("id"))


@register("transaction_ids", "SELECT event_id, '4c' || lower(lpad(to_hex(event_id * 7919 % 16777216), 6, '0')) AS id FROM events")
def transaction_ids(spark: SparkSession, d: str) -> DataFrame:
    """H41"""
    return table(spark, d, "events").select("event_id", display.hex_text(codecs.lookup_transaction_id(F.col("event_id") * 7919)).alias("id"))


@register("piece_math", "SELECT doc_id, ceil(n_chars / 16384.0)::BIGINT AS pieces, least(16384, n_chars - (ceil(n_chars / 16384.0)::BIGINT - 1) * 16384)::BIGINT AS last FROM documents")
def piece_math(spark: SparkSession, d: str) -> DataFrame:
    """H44"""
    n = codecs.piece_count(F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", n.alias("pieces"), codecs.piece_length(F.col("n_chars"), n - 1).alias("last"))


@register("sequence_after", "SELECT event_id, ((event_id * 97 - user_id) % 65536 + 65536) % 65536 < 32768 AND event_id * 97 <> user_id AS after FROM events")
def sequence_after(spark: SparkSession, d: str) -> DataFrame:
    """H45"""
    return table(spark, d, "events").select("event_id", codecs.sequence_after(F.col("event_id") * 97, F.col("user_id")).alias("after"))


@register("clock_32", "SELECT event_id, (epoch_us(ts) % 4294967296)::BIGINT AS clock FROM events")
def clock_32(spark: SparkSession, d: str) -> DataFrame:
    """H49, H54"""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("event_id", F.pmod(micros, F.lit(4294967296)).alias("clock"))


@register("sha1_verify", "SELECT doc_id, doc_id % 2 = 0 AS good FROM documents")
def sha1_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every second hash is of other bytes"""
    other = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    return table(spark, d, "documents").select("doc_id", codecs.verified(F.col("text").cast("binary"), F.unhex(F.sha1(other))).alias("good"))


@register("compact_samples_explode", "WITH s AS (SELECT doc_id, sha1(doc_id::VARCHAR) AS a, sha1(doc_id::VARCHAR || 'b') AS b FROM documents) SELECT doc_id, a AS sample FROM s UNION ALL SELECT doc_id, b FROM s")
def compact_samples_explode(spark: SparkSession, d: str) -> DataFrame:
    """Two hashes and three bytes that are too many"""
    key = F.col("doc_id").cast("string")
    raw = F.concat(F.unhex(F.sha1(key)), F.unhex(F.sha1(F.concat(key, F.lit("b")))), F.unhex(F.lit("010203")))
    return table(spark, d, "documents").select("doc_id", F.explode(codecs.cut(raw, codecs.ID_LENGTH)).alias("s")).select("doc_id", display.hex_text(F.col("s")).alias("sample"))


@register("compact_nodes", f"SELECT c_custkey, sha1(c_custkey::VARCHAR) AS node_id, {_IP} AS ip, (c_custkey * 37 % 65536)::INT AS port FROM customer")
def compact_nodes(spark: SparkSession, d: str) -> DataFrame:
    """H33, H34"""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    k = F.col("c_custkey")
    raw = F.concat(F.unhex(F.sha1(k.cast("string"))), byte(k * 7919 % 256), byte(k * 31 % 256), byte(k % 256), byte(k % 251), F.unhex(F.lpad(F.hex(k * 37 % 65536), 4, "0")))
    nodes = table(spark, d, "customer").select("c_custkey", F.explode(codecs.cut(raw, codecs.NODE4)).alias("n"))
    end = F.substring("n", 21, 6)
    return nodes.select("c_custkey", display.hex_text(F.substring("n", 1, 20)).alias("node_id"), codecs.compact_ip4(end).alias("ip"), codecs.compact_port(end).alias("port"))


@register("bencode_roundtrip", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'd1:ki' || json_extract_string(props, '$.k') || 'ee' AS encoded FROM events")
def bencode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """H30-H32"""
    rows = table(spark, d, "events").select("event_id", codecs.bencode_json("props").alias("b"))
    return rows.withColumn("v", codecs.bdecode_json("b")).select("event_id", F.get_json_object("v.json", "$.k").cast("long").alias("k"), F.col("b").cast("string").alias("encoded"))


@register("info_dict_summary", sql("SELECT doc_id, name, greatest(1, len(paths))::BIGINT AS file_count, (CASE WHEN len(paths) = 0 THEN size ELSE 7 * len(paths) END)::BIGINT AS total_size FROM docs WHERE name <> ''", "docs"))
def info_dict_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as info dictionaries and summarised"""
    several = F.transform("paths", lambda p: F.struct(F.lit(7).alias("length"), F.array(p).alias("path")))
    one = F.to_json(F.struct("name", F.lit(16384).alias("piece length"), F.col("size").alias("length")))
    many = F.to_json(F.struct("name", F.lit(16384).alias("piece length"), several.alias("files")))
    raw = docs(spark, d).select("doc_id", codecs.bencode_json(F.when(F.size("paths") == 0, one).otherwise(many)).alias("raw"))
    found = raw.withColumn("s", codecs.info_summaries("raw")).where(F.col("s.error").isNull())
    return found.select("doc_id", "s.name", "s.file_count", F.col("s.total_size").cast("long").alias("total_size"))


@register("backoff_schedule", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN least(30.0, pow(2.0, event_id % 9 - 1))::DOUBLE ELSE 0.0 END AS wait, epoch(ts) + 30.0 * (event_id % 3) AS next FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """H51, H52"""
    return table(spark, d, "events").select("event_id", codecs.backoff(F.col("event_id") % 9).alias("wait"), codecs.next_lookup(epoch("ts"), F.col("event_id") % 3).alias("next"))


@register("next_batch", "SELECT event_id, CASE WHEN value + 1.5 > value * 1.01 THEN value + 1.5 ELSE value * 1.01 + 1.5 END AS next FROM events")
def next_batch(spark: SparkSession, d: str) -> DataFrame:
    """H53"""
    return table(spark, d, "events").select("event_id", codecs.next_batch(F.col("value"), F.col("value") * 1.01, 1.5).alias("next"))


@register("json_files_roundtrip", sql("SELECT doc_id, len(paths)::INT AS files, coalesce(paths[1], '') AS first FROM docs", "docs"))
def json_files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """H57, H55"""
    files = F.to_json(F.transform("paths", lambda p: F.struct(p.alias("path"), F.lit(7).alias("length"))))
    back = docs(spark, d).select("doc_id", F.from_json(files, "array<struct<path:string,length:bigint>>").alias("f"))
    return back.select("doc_id", F.size("f").alias("files"), F.coalesce(F.get("f", F.lit(0))["path"], F.lit("")).alias("first"))


# Folds and statistics


_WINDOWS = """WITH RECURSIVE w AS (
  SELECT key, min(moment) AS start FROM obs GROUP BY key
  UNION ALL SELECT w.key, min(o.moment) FROM w JOIN obs o ON o.key = w.key AND o.moment - w.start >= 86400 GROUP BY w.key),
p AS (SELECT o.key, o.seq, max(w.start) AS start, any_value(o.moment) AS moment FROM obs o JOIN w ON w.key = o.key AND w.start <= o.moment GROUP BY o.key, o.seq)
SELECT key, seq, row_number() OVER (PARTITION BY key, start ORDER BY moment, seq) <= 2 AS allowed FROM p"""


@register("rate_limited_packets", sql(_WINDOWS, "obs"))
def rate_limited_packets(spark: SparkSession, d: str) -> DataFrame:
    """Two packets a day and key at most"""
    return stateful.rate_limited(obs(spark, d).select("key", "seq", "moment"), 2, 86400.0)


_BUCKET = """WITH RECURSIVE r AS (SELECT seq % 16 AS key, seq, floor(moment) AS moment, row_number() OVER (PARTITION BY seq % 16 ORDER BY floor(moment), seq) AS i FROM obs),
b AS (
  SELECT key, seq, i, moment, 2.0::DOUBLE AS had FROM r WHERE i = 1
  UNION ALL SELECT r.key, r.seq, r.i, r.moment, least(2.0::DOUBLE, (CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END) + (r.moment - b.moment) * 2.0::DOUBLE) FROM b JOIN r ON r.key = b.key AND r.i = b.i + 1)
SELECT key, seq, had >= 1 AS allowed FROM b"""


@register("token_bucket", sql(_BUCKET, "obs"))
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """I4"""
    return stateful.token_bucket(obs(spark, d).select((F.col("seq") % 16).alias("key"), "seq", F.floor("moment").cast("double").alias("moment")), 2.0)


def _steps(rows: DataFrame) -> DataFrame:
    """Sightings as steps of the fetch state machine."""
    kind = F.when(F.col("source") == "announce_peer", "peer").when(F.col("source") == "get_peers", "lookup").when(F.col("seq") % 10 == 0, "ok").otherwise(F.when(F.col("seq") % 2 == 0, "timeout").otherwise("refused"))
    return rows.select("key", "seq", kind.alias("kind"), "peer")


_MACHINE = """WITH RECURSIVE s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, peer, CASE WHEN source = 'announce_peer' THEN 'peer' WHEN source = 'get_peers' THEN 'lookup' WHEN seq % 10 = 0 THEN 'ok' WHEN seq % 2 = 0 THEN 'timeout' ELSE 'refused' END AS kind FROM obs),
f AS (
  SELECT DISTINCT key, 0::BIGINT AS i, []::BIGINT[] AS peers, []::BIGINT[] AS failed, 0 AS attempts, 0 AS lookups, 'pending' AS state, '' AS error FROM s
  UNION ALL SELECT key, i, CASE WHEN bad THEN old[1:len(old) - 1] ELSE own END, CASE WHEN bad THEN list_append(failed, old[len(old)]) ELSE failed END, attempts + bad::INT, lookups + (kind = 'lookup')::INT,
    CASE WHEN kind = 'ok' THEN 'done' WHEN dry THEN 'failed' WHEN bad AND (attempts >= 2 OR (len(old) = 1 AND lookups >= 2)) THEN 'failed' ELSE state END,
    CASE WHEN kind = 'ok' THEN '' WHEN dry THEN 'no_peers' WHEN bad AND attempts < 2 AND len(old) = 1 AND lookups >= 2 THEN 'no_peers' WHEN bad THEN kind ELSE error END
  FROM (SELECT *, kind = 'lookup' AND len(own) = 0 AND lookups >= 1 AND state = 'pending' AS dry, kind IN ('timeout', 'refused') AND state = 'pending' AND len(old) > 0 AS bad
    FROM (SELECT s.key, s.i, s.kind, f.peers AS old, f.failed, f.attempts, f.lookups, f.state, f.error,
      CASE WHEN s.peer IS NOT NULL AND s.kind IN ('peer', 'lookup') AND NOT list_contains(f.failed, s.peer) AND f.state <> 'done' THEN list_append(list_filter(f.peers, lambda x: x <> s.peer), s.peer)[-32:] ELSE f.peers END AS own
      FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)))
SELECT key, arg_max(state, i) AS state, arg_max(attempts, i) AS attempts, arg_max(lookups, i) AS lookups, len(arg_max(peers, i))::INT AS peers, arg_max(error, i) AS error FROM f GROUP BY key"""


@register("fetch_state_fold", sql(_MACHINE, "obs"))
def fetch_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """I2"""
    return stateful.fetch_states(_steps(obs(spark, d)))


_OUTCOMES = """WITH r AS (SELECT key, seq, seq / 1000 AS moment, peer FROM obs),
w AS (SELECT key, peer, row_number() OVER o AS n, moment - first_value(moment) OVER o >= 6 AS late FROM r WINDOW o AS (PARTITION BY key ORDER BY moment, seq)),
v AS (SELECT *, peer IS NOT NULL AND NOT late AND row_number() OVER (PARTITION BY key, peer, late ORDER BY n) = 1 AS fresh FROM w),
c AS (SELECT key, n, late, count(*) FILTER (fresh) OVER o AS peers, count(*) FILTER (peer IS NOT NULL AND NOT late) OVER o AS replies FROM v WINDOW o AS (PARTITION BY key ORDER BY n)),
e AS (SELECT *, CASE WHEN late THEN 'deadline' WHEN peers >= 8 THEN 'peers' WHEN replies >= 2 THEN 'replies' WHEN n >= 16 THEN 'queries' END AS why FROM c)
SELECT DISTINCT ON (key) key, coalesce(why, 'exhausted') AS reason, n::INT AS queries, peers::INT AS peers FROM e ORDER BY key, why IS NULL, CASE WHEN why IS NULL THEN -n ELSE n END"""


@register("lookup_outcomes", sql(_OUTCOMES, "obs"))
def lookup_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """When recorded replies end a lookup"""
    return stateful.lookup_outcomes(obs(spark, d).select("key", "seq", (F.col("seq") / 1000).alias("moment"), "peer"))


@register("reason_histogram", sql("SELECT 'fetch_fail_' || source AS metric, count(*)::BIGINT AS value FROM obs WHERE source <> 'sample' GROUP BY 1", "obs"))
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    """D5"""
    return stats.reasons(obs(spark, d).select(F.when(F.col("source") == "sample", "ok").otherwise(F.col("source")).alias("outcome")))


@register(
    "stats_union",
    sql(
        """SELECT 'observations' AS metric, count(*)::DOUBLE AS value FROM obs UNION ALL SELECT 'hashes_seen', count(DISTINCT key)::DOUBLE FROM obs
UNION ALL SELECT 'documents', count(*)::DOUBLE FROM docs UNION ALL SELECT 'size', sum(size)::DOUBLE FROM docs UNION ALL SELECT 'last_id', max(doc_id)::DOUBLE FROM docs""",
        "obs",
        "docs",
    ),
)
def stats_union(spark: SparkSession, d: str) -> DataFrame:
    """Documents named twice, the later value wins"""
    live = obs(spark, d).agg(F.count("*").alias("observations"), F.countDistinct("key").alias("hashes_seen"), F.lit(-1).alias("documents"))
    totals_ = store.totals(docs(spark, d).select(F.col("doc_id").alias("id"), "size"))
    return stats.union([stats.long_form(live), stats.long_form(totals_)])


@register("backlog_sizes", sql("SELECT 'backlog_documents' AS metric, (SELECT count(*) FROM docs)::DOUBLE AS value UNION ALL SELECT 'backlog_counters', (SELECT count(*) FROM counts)::DOUBLE UNION ALL SELECT 'backlog_dropped', 0.0", "docs", "counts"))
def backlog_sizes(spark: SparkSession, d: str) -> DataFrame:
    """D11"""
    return stats.backlog(docs(spark, d), catalog.counters(obs(spark, d)))


_DELTA = "WITH e AS (SELECT key, seq, CASE WHEN source = 'announce_peer' THEN 1 ELSE -1 END AS delta FROM obs), o AS (SELECT key, seq, sum(delta) OVER (PARTITION BY key ORDER BY seq)::BIGINT AS open FROM e) SELECT key, seq, open, max(open) OVER (PARTITION BY key ORDER BY seq)::BIGINT AS most FROM o"


@register("in_flight", sql(_DELTA, "obs"))
def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """D12, D13"""
    rows = obs(spark, d).select("key", "seq", F.when(F.col("source") == "announce_peer", 1).otherwise(-1).alias("delta"))
    return stateful.high_water(stateful.in_flight(rows), "open").drop("delta")


@register(
    "transport_fallback",
    sql(
        """WITH a AS (SELECT key, seq, source, CASE WHEN seq % 37 = 0 THEN 'ok' WHEN seq % 3 = 0 THEN 'closed_on_handshake' ELSE 'connect' END AS outcome FROM obs)
SELECT key, arg_min(source, seq) FILTER (outcome = 'ok') AS transport, coalesce(max('ok') FILTER (outcome = 'ok'), arg_min(outcome, seq) FILTER (outcome <> 'connect'), arg_min(outcome, seq)) AS outcome FROM a GROUP BY key""",
        "obs",
    ),
)
def transport_fallback(spark: SparkSession, d: str) -> DataFrame:
    """I17"""
    outcome = F.when(F.col("seq") % 37 == 0, "ok").when(F.col("seq") % 3 == 0, "closed_on_handshake").otherwise("connect")
    return stateful.first_success(obs(spark, d).select("key", "seq", F.col("source").alias("transport"), outcome.alias("outcome")))


@register("piece_reassembly", "SELECT doc_id AS key, sha1(text) AS sha1 FROM documents")
def piece_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into pieces, sent twice and out of order, joined again"""
    raw = F.col("text").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / 16384)).cast("int")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), raw.alias("raw"), F.octet_length(raw).alias("size"), F.explode(F.sequence(n - 1, F.lit(0))).alias("piece"))
    pieces = rows.select("key", "piece", F.substring(F.col("raw"), F.col("piece") * 16384 + 1, F.lit(16384)).alias("data"), "size")
    return stateful.reassembled(pieces.unionByName(pieces.where("piece = 0"))).select("key", F.sha1("raw").alias("sha1"))


@register("packet_gaps", "WITH p AS (SELECT DISTINCT l_orderkey AS key, l_linenumber AS seq FROM lineitem), r AS (SELECT *, seq - row_number() OVER (PARTITION BY key ORDER BY seq) AS run FROM p) SELECT key, min(seq) AS first, max(seq) AS last, count(*)::BIGINT AS packets FROM r GROUP BY key, run")
def packet_gaps(spark: SparkSession, d: str) -> DataFrame:
    """I19"""
    return stateful.gaps(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq")))


@register("datagram_routes", "SELECT CASE event_type WHEN 'view' THEN 'ping' WHEN 'click' THEN 'get_peers' WHEN 'signup' THEN 'find_node' ELSE 'error 204' END AS answer, count(*)::BIGINT AS packets FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def datagram_routes(spark: SparkSession, d: str) -> DataFrame:
    """Events written as queries, a fourth of them cut off, decoded and routed"""
    method = F.when(F.col("event_type") == "view", "ping").when(F.col("event_type") == "click", "get_peers").when(F.col("event_type") == "signup", "find_node").otherwise(F.col("event_type"))
    whole = F.concat(F.lit("d1:ad2:id20:"), F.substring(F.sha1(F.col("user_id").cast("string")), 1, 20), F.lit("e1:q"), F.length(method).cast("string"), F.lit(":"), method, F.lit("1:t2:aa1:y1:qe"))
    payload = F.when(F.col("event_id") % 4 == 3, F.substring(whole, 1, 30)).otherwise(whole).cast("binary")
    found = datagrams.messages(table(spark, d, "events").select("event_id", payload.alias("payload")))
    return datagrams.answers(found).groupBy("answer").agg(F.count("*").alias("packets"))


# Flushing, crawling, checks


@register(
    "sighting_checks",
    """WITH o AS (SELECT event_id AS seq, user_id, CASE WHEN event_id % 7 = 0 THEN 'length' WHEN event_type = 'error' THEN 'source' END AS reject FROM events)
SELECT seq, reject, reject IS NULL AND seq = min(seq) FILTER (reject IS NULL) OVER (PARTITION BY user_id) AS created FROM o""",
)
def sighting_checks(spark: SparkSession, d: str) -> DataFrame:
    """Sightings with hashes that are cut off and sources that aren't known"""
    key = F.unhex(F.sha1(F.col("user_id").cast("string")))
    source = F.when(F.col("event_type") == "error", "rumour").otherwise("sample")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, F.substring(key, 1, 19)).otherwise(key).alias("info_hash"), source.alias("source"))
    return crawl.checked_sightings(rows).select("seq", "reject", "created")


@register(
    "metadata_checks",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'total_size' WHEN l_linenumber = 4 THEN 'piece_length' WHEN l_linenumber = 5 THEN 'file_count' WHEN l_linenumber = 6 THEN 'files' END AS reject FROM lineitem""",
)
def metadata_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records that are wrong in one field by turns"""
    n = F.col("l_linenumber")
    files = F.when(n == 6, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n == 3, -1).otherwise(F.col("l_quantity").cast("long")).alias("total_size"), F.when(n == 4, 0).otherwise(16384).alias("piece_length"), F.when(n == 5, 0).otherwise(2).alias("file_count"), files.alias("files")
    )
    return crawl.checked_metadata(rows).select("l_orderkey", "l_linenumber", "reject")


@register(
    "crawl_plan",
    """WITH q AS (SELECT c_custkey % 3 AS family, c_custkey AS seq, '10.0.' || (c_custkey % 200) || '.1' AS ip FROM customer),
b AS (SELECT '10.0.' || (s_suppkey % 200) || '.1' AS ip, max(s_suppkey * 10.0) AS until FROM supplier GROUP BY 1 HAVING max(s_suppkey * 10.0) > 300),
t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY seq) AS turn, CASE family WHEN 0 THEN 3 WHEN 1 THEN 2 END AS sockets FROM q)
SELECT family, seq, CASE WHEN b.ip IS NULL THEN 'sample_infohashes' ELSE 'find_node' END AS query, (turn - 1) % sockets AS socket FROM t LEFT JOIN b USING (ip) WHERE turn <= sockets * 20""",
)
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    """One step over two families with sockets and one without"""
    ip = lambda k: F.concat(F.lit("10.0."), F.col(k) % 200, F.lit(".1"))
    queue = table(spark, d, "customer").select((F.col("c_custkey") % 3).cast("int").alias("family"), F.col("c_custkey").alias("seq"), F.sha1(F.col("c_custkey").cast("string")).alias("node_id"), ip("c_custkey").alias("ip"), F.lit(6881).alias("port"))
    rest = table(spark, d, "supplier").select(ip("s_suppkey").alias("ip"), F.lit(6881).alias("port"), (F.col("s_suppkey") * 10.0).alias("until"))
    return crawl.plan(queue, rest, {0: 3, 1: 2}, 300.0, 20).select(F.col("family").cast("long").alias("family"), "seq", "query", F.col("socket").cast("long").alias("socket"))


@register(
    "global_counters",
    sql(
        """SELECT count(*)::BIGINT AS hashes_seen, count(*) FILTER (fetch_state = 'pending')::BIGINT AS fetch_pending, count(*) FILTER (fetch_state = 'in_progress')::BIGINT AS fetch_in_progress, count(*) FILTER (fetch_state = 'done')::BIGINT AS fetch_done,
count(*) FILTER (fetch_state = 'failed')::BIGINT AS fetch_failed, count(*) FILTER (fetch_state = 'done' AND key % 2 = 0)::BIGINT AS known_done, coalesce(sum(key) FILTER (fetch_state = 'done' AND key % 2 <> 0), 0)::BIGINT AS metadata_bytes,
(SELECT count(*) FROM obs)::BIGINT AS observations, (SELECT count(*) FROM obs WHERE seq % 100 = 0)::BIGINT AS evicted, count(*) + (SELECT count(*) FROM obs WHERE seq % 100 = 0) AS hashes_discovered FROM entries""",
        "entries",
    ),
)
def global_counters(spark: SparkSession, d: str) -> DataFrame:
    """D2, D14"""
    rows = entries(spark, d).withColumns({"known_from_store": F.col("key") % 2 == 0, "metadata_size": F.col("key")})
    return catalog.global_counters(rows, obs(spark, d), obs(spark, d).where("seq % 100 = 0"))


@register("bounded_queue_dropped", sql("SELECT key, seq, row_number() OVER (ORDER BY seq DESC) > 700 AS dropped FROM obs", "obs"))
def bounded_queue_dropped(spark: SparkSession, d: str) -> DataFrame:
    """I11"""
    return flushing.bounded(obs(spark, d).select("key", "seq"), 700)


@register(
    "counter_drain",
    sql("SELECT key, seq FROM (SELECT key, seq, key % 3 = 0 AS orphan, key % 2 = 0 AS in_store, peer IS NOT NULL AS gained FROM obs) WHERE gained AND (orphan OR in_store) ORDER BY orphan DESC, seq LIMIT 300", "obs"),
)
def counter_drain(spark: SparkSession, d: str) -> DataFrame:
    """Orphans first"""
    rows = obs(spark, d).select("key", "seq", (F.col("key") % 3 == 0).alias("orphan"), (F.col("key") % 2 == 0).alias("in_store"), F.col("peer").isNotNull().cast("long").alias("seen_delta"), F.lit(0).alias("announce_delta"))
    return flushing.drain_counters(rows, 300).select("key", "seq")


@register(
    "requeued_batch",
    sql("SELECT key, min(seq) AS seq, arg_max(source, seq) AS source FROM obs WHERE seq % 3 <> 1 AND (seq % 3 = 0 AND seq < 3000 OR seq % 3 = 2 AND seq >= 3000) GROUP BY key", "obs"),
)
def requeued_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of early rows put back before later ones"""
    rows = obs(spark, d).select("key", "seq", "source")
    return flushing.requeued(rows.where("seq % 3 = 2 and seq >= 3000"), rows.where("seq % 3 = 0 and seq < 3000"))


@register("missing_reset", sql("SELECT key, CASE WHEN key % 2 = 0 AND NOT (key % 3 = 0) AND fetch_state = 'done' THEN 'pending' ELSE fetch_state END AS fetch_state, CASE WHEN key % 2 = 0 THEN 0 ELSE seen_count END AS flushed_seen, key % 2 = 0 AND key % 3 = 0 AS document_queued FROM entries", "entries"))
def missing_reset(spark: SparkSession, d: str) -> DataFrame:
    """E5"""
    rows = entries(spark, d).select("key", "fetch_state", F.col("seen_count").alias("flushed_seen"), F.col("announce_count").alias("flushed_announce"), (F.col("key") % 3 == 0).alias("has_metadata"), F.lit(True).alias("in_store"))
    return flushing.reset_missing(rows, rows.where("key % 2 = 0")).select("key", "fetch_state", "flushed_seen", "document_queued")


@register("last_flush", "WITH b AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 2 = 0 THEN 'documents' ELSE 'counters' END AS kind, 0.25 AS seconds FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT *, coalesce(sum(seconds) OVER (ORDER BY kind DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM b) SELECT kind, seq FROM r WHERE begins < 3")
def last_flush(spark: SparkSession, d: str) -> DataFrame:
    """I16"""
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.when(F.col("o_custkey") % 2 == 0, "documents").otherwise("counters").alias("kind"), F.col("o_orderkey").alias("seq"), F.lit(0.25).alias("seconds"))
    return flushing.last_flush(rows).select("kind", "seq")


_TRIES = """WITH a AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'connect' WHEN 2 THEN 'closed_on_handshake' ELSE 'timeout' END AS tcp, CASE WHEN user_id % 3 = 0 THEN 'ok' ELSE 'connect' END AS enc,
  CASE user_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'connect_timeout' ELSE 'closed' END AS utp, user_id % 5 <> 0 AS free, user_id % 7 = 0 AS six FROM events),
b AS (SELECT *, CASE WHEN tcp = 'closed_on_handshake' THEN enc ELSE tcp END AS first, 1.0 + CASE WHEN tcp = 'closed_on_handshake' THEN 0.5 ELSE 0 END AS spent FROM a),
c AS (SELECT *, first = 'connect' AND free AND NOT six AS other, first = 'connect' AND free AND NOT six AND utp <> 'connect_timeout' AS told FROM b)
SELECT seq, CASE WHEN told THEN 'utp' WHEN tcp = 'closed_on_handshake' THEN 'encrypted' ELSE 'tcp' END AS route, CASE WHEN told AND utp = 'ok' THEN 'ok' WHEN told THEN 'utp_' || utp ELSE first END AS outcome, (spent + CASE WHEN other THEN 2.0 ELSE 0 END)::DOUBLE AS seconds FROM c"""


@register("transport_attempts", _TRIES)
def transport_attempts(spark: SparkSession, d: str) -> DataFrame:
    """What each attempt comes to by the rules of fallback"""
    k, u = F.col("event_id") % 4, F.col("user_id")
    part = lambda outcome, seconds: F.struct(outcome.alias("outcome"), F.lit(seconds).alias("seconds"))
    tcp = part(F.when(k == 0, "ok").when(k == 1, "connect").when(k == 2, "closed_on_handshake").otherwise("timeout"), 1.0)
    enc, utp = part(F.when(u % 3 == 0, "ok").otherwise("connect"), 0.5), part(F.when(u % 4 == 0, "ok").when(u % 4 == 1, "connect_timeout").otherwise("closed"), 2.0)
    ip = F.when(u % 7 == 0, "2a00::1").otherwise("8.8.8.8")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), *[v.alias(n) for n, v in fetching.attempt(ip, tcp, enc, utp, u % 5 != 0).items()])


@register(
    "resend_times",
    """WITH p AS (SELECT event_id, user_id AS acked FROM events), w AS (SELECT event_id, acked, unnest([1, 3, 7, 15, 31]) AS w FROM p)
SELECT event_id, count(*) FILTER (w < 31 AND w < least(acked, 20))::INT AS again, count(*) FILTER (w < least(acked, 20)) > 4 AS given_up FROM w GROUP BY event_id""",
)
def resend_times(spark: SparkSession, d: str) -> DataFrame:
    """I19"""
    rows = table(spark, d, "events").select(F.lit(0).alias("key"), F.col("event_id").alias("number"), F.lit(0.0).alias("moment"), F.col("user_id").cast("double").alias("acked"))
    return stateful.resends(rows, 20.0).select(F.col("number").alias("event_id"), F.size("again").alias("again"), "given_up")


@register(
    "compact_nodes6",
    "SELECT s_suppkey AS seq, sha1(s_suppkey::VARCHAR) AS node_id, '2a00:1450::' || lower(to_hex(s_suppkey + 1)) AS ip, (s_suppkey % 65536)::INT AS port FROM supplier",
)
def compact_nodes6(spark: SparkSession, d: str) -> DataFrame:
    """IPv6 nodes of replies"""
    k = F.col("s_suppkey")
    raw = F.concat(F.unhex(F.sha1(k.cast("string"))), F.unhex(F.lit("2a0014500000000000000000")), F.unhex(F.lpad(F.hex(k + 1), 8, "0")), F.unhex(F.lpad(F.hex(k % 65536), 4, "0")))
    rows = table(spark, d, "supplier").select(k.alias("seq"), F.lit("r").alias("kind"), F.lit(None).cast("binary").alias("nodes"), raw.alias("nodes6"))
    return datagrams.nodes(rows).select("seq", display.hex_text(F.col("node_id")).alias("node_id"), "ip", "port")


# Streams: over all files at once, so they must agree with the batch forms.


@register("stream_sighting_counters", ORACLES["sighting_counters"])
def stream_sighting_counters(spark: SparkSession, d: str) -> DataFrame:
    """I1, A1"""
    return streams.counters(spark, f"{d}/events.parquet")


@register("stream_dedup_nodes", sql("SELECT DISTINCT key, peer FROM obs WHERE peer IS NOT NULL", "obs"))
def stream_dedup_nodes(spark: SparkSession, d: str) -> DataFrame:
    """D7"""
    return streams.distinct_peers(spark, f"{d}/events.parquet")


@register("stream_delta_upsert", sql("SELECT info_hash, name, size, file_count, c.seen_count, c.announce_count, c.first_seen, c.last_seen FROM docs JOIN counts c ON doc_id = key", "docs", "counts"))
def stream_delta_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A16, A20, E1, E3"""
    return streams.upserted(spark, f"{d}/events.parquet", docs(spark, d))


@register("stream_state_machine", ORACLES["fetch_state_fold"])
def stream_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """I2"""
    return streams.fetch_states(spark, f"{d}/events.parquet", _steps)

