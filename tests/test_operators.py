"""Operators on scripted events."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallybook.operators import catalog, datagrams, index, nearest, search, stateful, stats, store

DOC = "doc_id long, info_hash string, name string, paths array<string>, size long, file_count long, seen_count long, announce_count long, first_seen double, last_seen double"


def doc(n, name, paths=(), seen=1, last=1.0, size=7):
    return n, f"{n:040x}", name, list(paths), size, max(1, len(paths)), seen, 0, 1.0, last


@pytest.fixture(scope="module")
def library(spark):
    docs = [
        doc(1, "Ubuntu Desktop amd64", ["readme.txt"], 5), doc(2, "ubuntu server", ["docs/desktop.md"], 9), doc(3, "Fedora", ["ubuntu/desktop.iso"], 50), doc(4, "Café Crème", ["musique"], 2),
        doc(5, "plain", [f"f{k}" for k in range(20)] + ["twentyfirst"], 1), doc(6, "ubunto mix", [], 3),
    ]
    d = spark.createDataFrame(docs, DOC).cache()
    p = index.postings(d).cache()
    return d, p, index.typo_index(index.vocabulary(p)).cache()


def ids(rows):
    return [int(r.info_hash, 16) for r in rows.collect()]


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("ubuntu desktop", [1, 3, 2]),  # name matches first, then by sightings; terms may be split over name and files
        ("ubuntu desk", [1, 3, 2]),  # prefix of the last term
        ("ubu desktop", []),  # not of others
        ("cafe creme", [4]), ("CAFÉ", [4]), ("twentyfirst", []), ("f19", [5]), ("", [3, 2, 1, 6, 4, 5]), ("!!", [3, 2, 1, 6, 4, 5]),
        ("ubutnu", [2, 1, 3]), ("ubuntu zzzz", []), ("ubuntu", [2, 1, 3, 6]),
    ],
)
def test_search(library, query, found):
    assert ids(search.search(*library, query)) == found


def test_search_limits_and_sorts(library):
    assert ids(search.search(*library, "ubuntu", 2)) == [2, 1]
    assert ids(search.search(*library, "ubuntu", 20, "seen_count", True)) == [3, 2, 1, 6]
    assert ids(search.search(*library, "ubuntu", 3, "seen_count", False)) == [1, 2, 3]
    assert ids(search.search(*library, "ubuntu", 20, "name", False)) == [3, 6, 1, 2]


def test_memory_search(library):
    assert ids(search.scan_memory(library[0], " UBUNTU/desk", 9)) == [3]
    assert ids(search.scan_memory(library[0], "twentyfirst", 9)) == [5]


OBS = "seq long, key long, source string, moment double, peer long"


def test_counters_take_first_arrival(spark):
    rows = [(1, 7, "get_peers", 9.0, None), (2, 7, "announce_peer", 3.0, 5), (3, 7, "sample", 20.0, None), (4, 8, "sample", 1.0, None)]
    found = {r.key: (r.seen_count, r.announce_count, r.first_seen, r.last_seen) for r in catalog.counters(spark.createDataFrame(rows, OBS)).collect()}
    assert found == {7: (3, 1, 9.0, 20.0), 8: (1, 0, 1.0, 1.0)}


def test_recent_peers_keep_last_touch(spark):
    rows = [(k, 1, "announce_peer", 0.0, p) for k, p in enumerate([1, 2, 3, 1, 4])]
    assert catalog.recent_peers(spark.createDataFrame(rows, OBS), 3).first().peers == [3, 1, 4]


ENTRY = "key long, seq long, seen_count long, last_seen double, has_metadata boolean, peers long, evictable boolean"


def test_eviction_in_two_phases(spark):
    rows = [(1, 1, 1, 1.0, False, 0, False), (2, 2, 1, 5.0, False, 0, True), (3, 3, 9, 1.0, True, 0, True), (4, 4, 2, 1.0, False, 0, True), (5, 5, 1, 1.0, False, 3, True), (6, 6, 1, 0.0, False, 0, True)]
    entries = spark.createDataFrame(rows, ENTRY)
    pick = lambda n: [(r.key, r.phase) for r in catalog.eviction_victims(entries, n).collect()]
    assert pick(20) == [(2, 1)] and pick(40) == [(2, 1), (6, 1)] and pick(80) == [(2, 1), (6, 1), (4, 2), (5, 2)]


def test_nearest_is_unsigned(spark):
    nodes = [("ff" * 20, "a", 1, 1), ("7f" + "00" * 19, "b", 1, 2), ("00" * 20, "c", 1, 3), ("00" * 20, "d", 1, 4)]
    rows = spark.createDataFrame(nodes, "node_id string, ip string, port int, seq long")
    assert [r.ip for r in nearest.nearest(rows, "00" * 20, 3).collect()] == ["c", "d", "b"]
    assert [r.ip for r in nearest.shortlist(rows, rows.where("ip = 'b'"), "00" * 20).collect()] == ["d", "a"]


CHANGE = "info_hash string, seq long, name string, size long, file_count long, seen_count long, announce_count long, first_seen double, last_seen double"


def test_upserts_are_applied_once(spark, tmp_path):
    to = store.Store(spark, f"file://{tmp_path}/s")
    assert to.read() is None and to.file_size() == 0 and to.open() and not to.open()
    one = spark.createDataFrame([("a", 1, "n", 7, 1, 2, 1, 5.0, 6.0), ("a", 2, "m", 9, 1, 1, 0, 4.0, 9.0)], CHANGE)
    assert to.apply(one, 0) and not to.apply(one, 0)
    assert to.apply(spark.createDataFrame([("a", 3, "new", 1, 1, 1, 1, 1.0, 2.0), ("b", 4, "b", 1, 1, 1, 0, 1.0, 2.0)], CHANGE), 1)
    found = {r.info_hash: (r.name, r.size, r.seen_count, r.announce_count, r.first_seen, r.last_seen) for r in to.read().collect()}
    assert found == {"a": ("n", 7, 4, 2, 1.0, 9.0), "b": ("b", 1, 1, 0, 1.0, 2.0)}
    assert to.file_size() > 0 and [v[1] for v in to.versions()] == [0, 1]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    to = store.Store(spark, f"file://{tmp_path}/s")
    to.open()
    to.apply(spark.createDataFrame([("a", 1, "n", 7, 1, 2, 1, 5.0, 6.0)], CHANGE), 0)
    with pytest.raises(Exception, match="nope"):
        to.write(to.read().withColumn("x", F.raise_error(F.lit("nope"))), 1)
    assert to.read().count() == 1 and to.last_batch() == 0
    (tmp_path / "s/.layout.json.crc").unlink()
    (tmp_path / "s/layout.json").write_text('{"version": 2}')
    with pytest.raises(ValueError, match="layout"):
        store.Store(spark, f"file://{tmp_path}/s").open()


def test_totals_do_not_overflow(spark):
    rows = spark.createDataFrame([(1, 2**63 - 1), (2, 2**63 - 1), (3, 1)], "id long, size long")
    assert store.caught_up(store.totals(rows.where("id < 2")), rows).first().asDict() == {"documents": 3, "size": 2.0**64, "last_id": 3}
    assert store.totals(rows.where("id > 9")).first().asDict() == {"documents": 0, "size": 0.0, "last_id": 0}


def test_rate_limit(spark):
    times = [0.0] * 3 + [5.0, 10.0, 19.9, 20.0, 20.0, 20.0]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "key long, seq long, moment double")
    found = [r.allowed for r in stateful.rate_limited(rows, 2).orderBy("seq").collect()]
    assert found == [True, True, False, False, True, True, True, True, False]


def test_token_bucket(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.0, 0.0, 0.0, 0.5, 0.5, 3.0, 3.0, 3.0])], "key long, seq long, moment double")
    assert [r.allowed for r in stateful.token_bucket(rows, 2.0).orderBy("seq").collect()] == [True, True, False, True, False, True, True, False]


@pytest.mark.parametrize(
    ("steps", "end"),
    [
        ([("lookup", None)] * 2, ("failed", 0, 2, 0, "no_peers")),
        ([("peer", 1), ("timeout", None)], ("pending", 1, 0, 0, "timeout")),
        ([("peer", 1), ("timeout", None), ("peer", 1)], ("pending", 1, 0, 0, "timeout")),
        ([("peer", 1), ("peer", 2), ("peer", 3), *[("refused", None)] * 3], ("failed", 3, 0, 0, "refused")),
        ([("peer", 1), ("lookup", 1), ("lookup", 1), ("timeout", None)], ("failed", 1, 2, 0, "no_peers")),
        ([("ok", None), ("peer", 1)], ("done", 0, 0, 0, "")),
    ],
)
def test_fetch_states(spark, steps, end):
    rows = spark.createDataFrame([(1, k, kind, p) for k, (kind, p) in enumerate(steps)], "key long, seq long, kind string, peer long")
    assert tuple(stateful.fetch_states(rows).first())[1:] == end


def test_lookup_outcomes(spark):
    rows = [(1, 1, 0.0, 5), (1, 2, 0.1, 6), (1, 3, 0.2, 7), (2, 1, 0.0, None), (2, 2, 7.0, 5), (3, 1, 0.0, None), *[(4, k, 0.0, None) for k in range(20)]]
    found = {r.key: (r.reason, r.queries, r.peers) for r in stateful.lookup_outcomes(spark.createDataFrame(rows, "key long, seq long, moment double, peer long")).collect()}
    assert found == {1: ("replies", 2, 2), 2: ("deadline", 2, 0), 3: ("exhausted", 1, 0), 4: ("queries", 16, 0)}


def test_datagrams(spark):
    a, b = hashlib.sha1(b"a").digest(), hashlib.sha1(b"b").digest()
    node = a + bytes([8, 8, 8, 8, 0, 80])
    sent = [datagrams.query("ping", b"t1", id=a), datagrams.query("vote", b"t2", id=a), datagrams.reply(b"t3", id=a, nodes=node * 2 + b"rest", samples=a + b + b"x"), datagrams.error(b"t4", 204, "no"), b"junk", b"i5e"]
    found = datagrams.messages(spark.createDataFrame([(k, p, "1.2.3.4", 7) for k, p in enumerate(sent)], "seq long, payload binary, ip string, port int")).cache()
    assert found.count() == 4 and [r.error for r in found.where("kind = 'e'").collect()] == [204]
    assert sorted(r.answer for r in datagrams.answers(found).collect()) == ["error 204", "ping"]
    assert [(r.pos, r.ip, r.port) for r in datagrams.nodes(found).collect()] == [(0, "8.8.8.8", 80), (1, "8.8.8.8", 80)]
    assert sorted(bytes(r.info_hash) for r in datagrams.samples(found).collect()) == sorted([a, b])
    asked = spark.createDataFrame([(b"t3", "1.2.3.4", 7, 1), (b"t3", "9.9.9.9", 7, 2)], "transaction binary, ip string, port int, lookup long")
    assert [r.lookup for r in datagrams.own_replies(found, asked).collect()] == [1]


def test_metadata_is_verified(spark):
    from tallybook.functions.codecs import bencode

    raw = bencode({"name": "n", "piece length": 1, "length": 5})
    rows = [(hashlib.sha1(raw).digest(), raw), (hashlib.sha1(b"").digest(), raw), (hashlib.sha1(b"x").digest(), b"x")]
    found = [(r.name, r.error) for r in datagrams.summaries(spark.createDataFrame(rows, "info_hash binary, raw binary")).collect()]
    assert found == [("n", None), ("n", "hash_mismatch"), (None, "bad_info_dict")]


def test_later_metrics_win(spark):
    part = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value long")
    assert {r.metric: r.value for r in stats.union([part(a=1, b=2), part(b=3)]).collect()} == {"a": 1.0, "b": 3.0}


def test_streamed_upserts_reach_every_document(spark, tmp_path):
    from tallybook.streaming import catalog as streams

    events = [(k, k * 100, "view", "{}") for k in range(5)] + [(9, 400, "purchase", '{"k": 1}')]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "user_id", "event_type", "props")
    rows.write.parquet(f"{tmp_path}/events")
    d = spark.createDataFrame([doc(k, f"n{k}") for k in (0, 100, 200, 400, 500)], DOC).select("doc_id", "info_hash", "name", "size", "file_count")
    found = {int(r.info_hash, 16): (r.seen_count, r.announce_count) for r in streams.upserted(spark, f"{tmp_path}/events", d).collect()}
    assert found == {0: (1, 0), 100: (1, 0), 200: (1, 0), 400: (2, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], OBS)
    assert catalog.counters(none).count() == catalog.recent_peers(none).count() == 0
    assert stateful.rate_limited(none.select("key", "seq", "moment")).count() == 0
    d = spark.createDataFrame([], DOC)
    p = index.postings(d)
    assert search.search(d, p, index.typo_index(index.vocabulary(p)), "x").count() == 0
