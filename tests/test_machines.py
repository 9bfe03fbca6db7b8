"""Lookups, fetches, flushes, crawl plans and answers on scripted events."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import DOC, doc

from tallybook.functions import codecs
from tallybook.operators import api, crawl, datagrams, fetching, flushing, index, lookups, stateful, stats, store

# Lookups


def near(*ids):
    return [(i, f"n{i}") for i in ids]


def run(starts, answers, **limits):
    return {k: (v[0], v[1], v[2], v[3].asked if v[3] else None, sorted(v[3].peers) if v[3] else None) for k, v in lookups.simulate(starts, answers, **limits).items()}


def test_a_hint_is_asked_first_and_alone():
    answers = {(1, "h"): (0.2, [], near(3)), (1, "n3"): (0.1, ["p", "q"], []), (1, "n2"): (0.1, ["r"], [])}
    assert run([(1, 0, 0.0, "h", near(2, 5))], answers)[1] == (True, "replies", pytest.approx(0.4), ["h", "n2", "n3"], ["p", "q", "r"])


def test_a_silent_hint_is_let_go_after_its_own_time():
    found = run([(1, 0, 0.0, "h", near(2))], {(1, "n2"): (0.5, ["p"], [])})[1]
    assert found[1:4] == ("exhausted", 1.5, ["h", "n2"])


def test_the_nearest_are_asked_one_at_a_time():
    answers = {(1, f"n{i}"): (0.1, [], near(i - 1) if i > 1 else []) for i in range(1, 9)}
    found = run([(1, 0, 0.0, None, near(8, 7))], answers)[1]
    assert found[3] == ["n7", "n6", "n5", "n4", "n3", "n2", "n1", "n8"] and found[1] == "exhausted" and found[2] == pytest.approx(0.8)


def test_silent_nodes_run_into_the_deadline():
    found = run([(1, 0, 0.0, None, near(*range(1, 20)))], {})[1]
    assert found[1:3] == ("deadline", 6.0) and len(found[3]) == 4  # 1.5 s each


def test_queries_and_peers_have_an_end():
    quick = {(1, f"n{i}"): (0.01, [], []) for i in range(1, 30)}
    assert run([(1, 0, 0.0, None, near(*range(1, 30)))], quick)[1][1] == "queries"
    many = {(1, "n1"): (0.1, [f"p{k}" for k in range(70)], [])}
    found = run([(1, 0, 0.0, None, near(1, 2))], many)[1]
    assert found[1] == "peers" and len(found[4]) == 50


def test_a_node_answers_four_at_once():
    starts = [(k, 0, 0.0, "h", []) for k in range(6)]
    found = run(starts, {(k, "h"): (0.5, ["p"], []) for k in range(6)})
    assert [found[k][0] for k in range(6)] == [True] * 4 + [False] * 2
    waiting = run([(k, 0, 0.0, None, near(1)) for k in range(6)], {(k, "n1"): (0.5, ["p"], []) for k in range(6)})
    assert [waiting[k][2] for k in range(6)] == [0.5] * 4 + [1.0] * 2


def test_the_budget_holds_lookups_back():
    found = run([(k, 0, 0.0, None, near(1)) for k in range(3)] + [(3, 0, 1.0, None, near(1))], {}, rate=2.0, per_node=99)
    assert [found[k][0] for k in range(4)] == [True, True, False, True]


def test_lookups_of_a_table(spark):
    node = "array<struct<id:long,address:string>>"
    starts = spark.createDataFrame([(1, 1, 0, 0.0, None, near(2)), (2, 1, 0, 0.0, "h", []), (3, 1, 0, 0.0, None, [])], f"scope long, lookup long, target long, moment double, hint string, seeds {node}")
    answers = spark.createDataFrame([(1, 1, "n2", 0.1, ["p"], []), (2, 1, "h", 0.1, None, None)], f"scope long, lookup long, address string, delay double, peers array<string>, nodes {node}")
    found = {r.scope: (r.started, r.reason, r.queries, r.peers) for r in lookups.run_lookups(starts, answers).collect()}
    assert found == {1: (True, "exhausted", 1, ["p"]), 2: (True, "exhausted", 1, []), 3: (False, None, 0, [])}
    assert lookups.run_lookups(starts.limit(0), answers).count() == 0


# Fetches

TRY = "key long, touched long, peer string, outcome string, route string, seconds double, unreachable boolean"


def job(spark, *turns):
    """Turns newest first."""
    rows = [(1, len(turns) - k, f"p{k}", outcome, "tcp", seconds, unreachable) for k, (outcome, seconds, unreachable) in enumerate(turns)]
    r = fetching.jobs(spark.createDataFrame(rows, TRY)).first()
    return r.outcome, round(r.seconds, 3), r.attempts, r.blamed


def test_fetch_jobs(spark):
    assert job(spark, ("ok", 1.0, False)) == ("ok", 1.0, 1, "")
    # The second starts after 0.3 s, the third after 0.6 s, the fourth when the first is over; the success ends all.
    assert job(spark, ("timeout", 1.0, False), ("ok", 5.0, False), ("timeout", 9.0, False), ("ok", 0.2, False)) == ("ok", 1.2, 4, "")
    assert job(spark, ("refused", 0.1, False), ("local_error", 0.1, False), ("timeout", 1.0, False)) == ("timeout", 1.2, 3, "p0,p2")
    assert job(spark, ("timeout", 9.0, True), ("ok", 1.0, False))[0] == "ok"
    assert job(spark, ("timeout", 9.0, True)) == ("skipped_unreachable", 0.0, 0, "p0")
    assert job(spark, ("stopped", 1.0, False)) == ("stopped", 1.0, 1, "")


def test_newest_peers_first_and_free_connections(spark):
    assert spark.sql("select array(1, 2, 3) as p").select(fetching.newest_first(F.col("p")).alias("p")).first().p == [3, 2, 1]
    rows = spark.createDataFrame([(k, "fetchable" if k else None, k, 0.0) for k in range(6)], "key long, queue string, seen_count long, last_seen double")
    assert [r.key for r in fetching.claims(rows, 253).collect()] == [5, 4, 3] and fetching.claims(rows, 256).count() == 0


def test_a_claimed_fetch_and_a_running_lookup():
    f = stateful.Fetch()
    for step in (("peer", 1), ("claim", None), ("release", None), ("claim", None), ("timeout", None), ("look", None), ("lookup", None), ("look", None)):
        f.apply(*step)
    assert (f.state, f.looking, f.lookups, f.attempts) == ("pending", True, 1, 1)
    again = stateful.Fetch(*json.loads(json.dumps(f.stored())))
    again.apply("lookup", None)
    assert (again.state, again.error) == ("failed", "no_peers")
    g = stateful.Fetch([1], [], 0, 2, "in_progress", "", True)
    g.apply("refused", 1)
    assert (g.state, g.error) == ("pending", "refused")  # a lookup is still running


# Pieces and packets


def test_piece_sessions(spark):
    size = 9 * codecs.PIECE + 5
    good = [("data", k, codecs.PIECE, size) for k in range(9)] + [("data", 9, 5, None)]
    cases = {1: good, 2: [good[8], *good], 3: [("other", 0, 0, None), *good[:3]], 4: [("reject", 2, 0, None)], 5: [("data", 0, 7, None)], 6: [("data", 0, codecs.PIECE, 1)]}
    rows = [(key, k, *m, size) for key, messages in cases.items() for k, m in enumerate(messages)]
    found = {r.key: (r.outcome, r.pieces, r.passed) for r in stateful.piece_sessions(spark.createDataFrame(rows, "key long, seq long, kind string, piece long, length long, total long, size long")).collect()}
    assert found == {1: ("done", 10, 0), 2: ("done", 10, 1), 3: ("open", 3, 1), 4: ("reject", 0, 0), 5: ("bad_piece", 0, 0), 6: ("bad_piece", 0, 0)}


def test_packets_in_order(spark):
    numbers = [65534, 65535, 1, 0, 0, 1, 65000, 4, 3, 2]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(numbers)], "key long, seq long, number int")
    found = [(r.delivered, r.last, r.waiting) for r in stateful.delivered(rows).orderBy("seq").collect()]
    assert found == [(1, 65534, 0), (1, 65535, 0), (0, 65535, 1), (2, 1, 0), (0, 1, 0), (0, 1, 0), (0, 1, 0), (0, 1, 1), (0, 1, 2), (3, 4, 0)]
    full = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 3), (1, 3, 1)], "key long, seq long, number int")
    assert [r.delivered for r in stateful.delivered(full, 1).orderBy("seq").collect()] == [1, 0, 0, 2]


def test_rows_without_a_key_are_one_key(spark):
    rows = spark.createDataFrame([(None, k, float(k)) for k in range(3)] + [(0, 9, 0.0)], "key long, seq long, moment double")
    assert sorted((r.key is None, r.seq, r.allowed) for r in stateful.rate_limited(rows, 1).collect()) == [(False, 9, True), (True, 0, True), (True, 1, False), (True, 2, False)]
    assert [r.allowed for r in stateful.token_bucket(rows.where("key is null"), 0.5).collect()] == [False] * 3


def test_large_keys_keep_their_value(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(big, 1, "peer", big), (None, 2, "peer", None)], "key long, seq long, kind string, peer long")
    assert {r.key for r in stateful.fetch_states(rows).collect()} == {big, None}


def test_hostile_numbers_are_missing(spark):
    sent = [b"d1:ad2:id20:" + b"x" * 20 + b"4:porti" + b"9" * 30 + b"ee1:q4:ping1:t1:a1:y1:qe", b"d1:eli" + b"9" * 40 + b"e2:noe1:t1:a1:y1:ee"]
    found = datagrams.messages(spark.createDataFrame([(k, p) for k, p in enumerate(sent)], "seq long, payload binary")).orderBy("seq").collect()
    assert [(r.kind, r.port, r.error) for r in found] == [("q", None, None), ("e", None, None)]


# Flushes


def test_flush_turns(spark):
    good = (True,) * 4
    ticks = [(0.0, *good), (0.1, *good), (0.3, *good), (1.0, True, False, True, True), (1.5, *good), (2.0, True, False, True, True), (3.9, *good), (4.0, *good), (31.0, *good)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(ticks)], "scope long, seq long, moment double, checks boolean, documents boolean, counters boolean, totals boolean")
    found = [(r.done, r.waits, r.errors) for r in flushing.turns(rows).orderBy("seq").collect()]
    assert found == [
        ("checks,documents", 0.0, 0), ("", 0.0, 0), ("checks", 0.0, 0), ("checks", 1.0, 1), ("", 1.0, 1), ("checks", 2.0, 2), ("", 2.0, 2), ("checks,documents", 0.0, 2), ("checks,documents,counters,totals", 0.0, 2),
    ]
    metrics = {r.metric: r.value for r in stats.index_metrics(flushing.turns(rows), spark.createDataFrame([(5, 2.0)], "documents long, size double")).collect()}
    assert metrics == {"documents": 5.0, "size": 2.0, "refreshes": 1.0, "errors": 2.0}


def test_failing_checks_are_switched_off_after_a_minute():
    s, now, good = flushing.Schedule(0.0), 0.0, dict.fromkeys(flushing.EVERY, True)
    while now < 70:
        s.turn(now, good | {"checks": False})
        assert s.open == (s.failing is not None and now - s.failing >= 60 and s.open)
        now = s.wake
    assert s.open and s.wait == 30.0
    s.turn(now, good)
    assert not s.open and s.failing is None and s.wait == 0.0


def test_failed_batches_go_back_in_front(spark):
    schema = "key long, seq long, name string"
    queue, batch = spark.createDataFrame([(3, 3, "c"), (1, 9, "new")], schema), spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], schema)
    back = flushing.requeued(queue, batch)
    assert [(r.key, r.seq, r.name) for r in flushing.drain_documents(back, 3).collect()] == [(1, 1, "new"), (2, 2, "b"), (3, 3, "c")]
    entries = spark.createDataFrame([(1, 5, 2, 3, 1), (2, 7, 0, 7, 0)], "key long, seen_count long, announce_count long, flushed_seen long, flushed_announce long")
    taken = spark.createDataFrame([(1, 4, 2)], "key long, seen_count long, announce_count long")
    assert [(r.key, r.flushed_seen, r.flushed_announce) for r in flushing.flushed(entries, taken, True).orderBy("key").collect()] == [(1, 4, 2), (2, 7, 0)]
    assert flushing.flushed(entries, taken, False).collect() == entries.collect()
    kept = flushing.orphans(entries.withColumns({"seq": F.col("key"), "last_seen": F.lit(1.0)}), entries.select("key"))
    assert [(r.key, r.seen_delta, r.announce_delta) for r in kept.collect()] == [(1, 2, 1)]


def test_settings():
    assert crawl.settings_error() is None and crawl.settings_error(port=6881, nodes=8, web_host="x", duration=None, interval=0.1, database="/tmp/x.db") is None
    bad = {"port": 70000, "nodes": 0, "web_host": "", "web_port": -1, "duration": float("inf"), "fetch_workers": 0, "batch_size": 0, "interval": 0, "database": ""}
    for name, value in bad.items():
        assert crawl.settings_error(**{name: value}).startswith("--" + name.replace("_", "-"))
    assert "exceeds" in crawl.settings_error(port=65535, nodes=2) and crawl.settings_error(port=-1, nodes=0).startswith("--port")
    assert "does not exist" in crawl.settings_error(database="/no/such/place/x.db")


def test_starving_families(spark):
    families = spark.createDataFrame([(4, 0.0), (6, 0.0), (8, 9.0)], "family int, last_bootstrap double")
    assert [r.family for r in crawl.starving(families, spark.createDataFrame([(4,)], "family int"), 10.0).collect()] == [6]


# Previous values and answers

CHANGE = "info_hash string, seq long, seen_count long, announce_count long, first_seen double"


def test_changes_of_one_batch_see_each_other(spark):
    stored = spark.createDataFrame([("a", 5, 1, 9.0)], "info_hash string, seen_count long, announce_count long, first_seen double")
    changes = spark.createDataFrame([("a", 1, 2, 1, 3.0), ("a", 2, 1, 0, 1.0), ("b", 3, 4, 0, 2.0), ("b", 4, 1, 0, 2.0)], CHANGE)
    found = [(r.seq, r.seen_count, r.announce_count, r.first_seen) for r in store.previous(stored, changes).orderBy("seq").collect()]
    assert found == [(1, 5, 1, 9.0), (2, 7, 2, 3.0), (3, None, None, None), (4, 4, 0, 2.0)]


def test_batches_rewrite_only_the_parts_they_touch(spark, tmp_path):
    to = store.Store(spark, f"file://{tmp_path}/s")
    to.open()
    schema = "info_hash string, seq long, name string, size long, file_count long, seen_count long, announce_count long, first_seen double, last_seen double"
    row = lambda k, seen: (f"h{k}", k, "n", 1, 1, seen, 0, 1.0, 1.0)
    to.apply(spark.createDataFrame([row(k, 1) for k in range(200)], schema), 0)
    before, parts = to.read().count(), len(list(tmp_path.glob("s/v00000000-*/part=*")))
    for batch in range(1, 5):
        to.apply(spark.createDataFrame([row(7, 1)], schema), batch)
    assert before == to.read().count() == 200 and to.read().agg(F.sum("seen_count")).first()[0] == 204
    assert len(list(tmp_path.glob("s/v00000004-*/part=*"))) == 1 and len(list(tmp_path.glob("s/v00000000-*/part=*"))) == parts - 1
    assert to.read(3).agg(F.sum("seen_count")).first()[0] == 203


@pytest.fixture
def answers(spark):
    docs = spark.createDataFrame([doc(1, "Ubuntu Desktop", ["a.iso"], 5), doc(2, "ubuntu server", [], 9)], DOC)
    peers = [("1.2.3.4", 5)]
    live = spark.createDataFrame(
        [(f"{1:040x}", 3, 1, 1.0, 2.0, "done", 0, "", 0, peers, True, "Live", 7, 16384, 1, [("a", 7)], False, 2.0, ("1.2.3.4", 5), ["a"]), (f"{2:040x}", 1, 0, 1.0, 1.0, "pending", 1, "timeout", 1, None, False, *[None] * 8, None), (f"{3:040x}", 1, 0, 1.0, 1.0, "pending", 0, "", 0, None, False, *[None] * 8, None)],
        f"info_hash string, seen_count long, announce_count long, first_seen double, last_seen double, fetch_state string, fetch_attempts int, last_error string, lookups_started int, peers array<{store.PEER}>, has_metadata boolean, {', '.join(f'{k} {v}' for k, v in store.METADATA.items())}, paths array<string>",
    )
    postings = index.postings(docs)
    stored = api.Stored(docs, postings, index.typo_index(index.vocabulary(postings)))
    detail = store.live_detail(live).join(live.select("info_hash", "paths"), "info_hash")
    return detail, stored


def test_answers(answers):
    live, stored = answers
    a = api.Api(live, lambda: {"hashes_seen": 3}, lambda: stored)
    assert a.answer("/api/stats") == (200, {"hashes_seen": 3}) and a.answer("/nowhere") == (404, {"error": "not found"})
    status, page = a.answer("/api/search", {"q": "ubuntu", "limit": "1"})
    assert status == 200 and page["count"] == 1 and page["engine"] == "sqlite" and page["results"][0]["name"] == "ubuntu server" and page["results"][0]["magnet"].startswith("magnet:?")
    status, one = a.answer(f"/api/torrent/{1:040X}")
    assert status == 200 and one["metadata"]["name"] == "Live" and one["peers"] == [{"ip": "1.2.3.4", "port": 5}] and one["metadata"]["source_peer"]["port"] == 5
    status, two = a.answer(f"/api/torrent/{2:040x}")
    assert status == 200 and two["fetch_state"] == "done" and two["metadata"]["name"] == "ubuntu server" and "dn=ubuntu" in two["magnet"]
    assert a.detail(f"{3:040x}")[1]["metadata"] is None and a.detail(f"{9:040x}")[0] == 404 and a.detail("xyz") == (400, {"error": "invalid info hash"})
    memory = api.Api(live, dict)
    status, page = memory.search({"q": "live"})
    assert status == 200 and page["engine"] == "memory" and [r["name"] for r in page["results"]] == ["Live"]
    assert json.loads(api.encoded((200, {"n": "é"}))[1]) == {"n": "é"} and api.encoded((200, {"n": "é"}))[1].isascii()


def test_a_store_that_is_away(spark, answers):
    live, stored = answers
    calls = []

    def away():
        calls.append(1)
        if len(calls) < fails + 1:
            return spark.read.parquet("/no/such/place")
        return stored

    a = api.Api(live, dict, away)
    fails = 1
    assert a.search({"q": "ubuntu"})[0] == 200 and len(calls) == 2
    fails, calls[:] = 99, []
    assert a.search({"q": "ubuntu"}) == (503, {"error": "search database unavailable"}) and len(calls) == 2
    assert a.detail(f"{9:040x}")[0] == 503 and a.detail(f"{2:040x}")[0] == 200


# Streams over several batches


@pytest.fixture
def recorded(spark, tmp_path):
    events = [(k, k % 7, ("purchase", "view", "signup")[k % 3], f'{{"k": {k % 5}}}') for k in range(60)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) as ts", "user_id", "event_type", "props")
    for k in range(4):
        rows.where(f"event_id between {15 * k} and {15 * k + 14}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return rows, f"{tmp_path}/events"


def test_streams_in_several_batches(spark, recorded):
    from tallybook.operators import catalog
    from tallybook.plans.queries import _steps
    from tallybook.sources import tables
    from tallybook.streaming import catalog as streams
    from tallybook.streaming.summary import Summary

    rows, path = recorded
    obs = tables.sightings(rows)
    listener = Summary(0.0)
    spark.streams.addListener(listener)
    plain = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    # Files of a batch come by time of change, so counters that depend on the order of arrival are left out here.
    assert plain(streams.counters(spark, path, 1), "key", "seen_count", "announce_count", "last_seen") == plain(catalog.counters(obs), "key", "seen_count", "announce_count", "last_seen")
    assert plain(streams.distinct_peers(spark, path, 1), "key", "peer") == plain(obs.where("peer is not null").select("key", "peer").distinct(), "key", "peer")
    assert plain(streams.distinct_peers(spark, path, 1, 1), "key", "peer") == plain(obs.where("peer is not null").select("key", "peer").distinct(), "key", "peer")
    docs = spark.createDataFrame([doc(k, f"n{k}") for k in range(7)], DOC).select("doc_id", "info_hash", "name", "size", "file_count")
    assert streams.upserted(spark, path, docs, 1).agg(F.sum("seen_count")).first()[0] == 60
    whole = stateful.fetch_states(_steps(obs))
    assert plain(streams.fetch_states(spark, path, _steps, 1), "key", "state", "lookups") == plain(whole, "key", "state", "lookups")
    spark.streams.removeListener(listener)
    assert listener.batches >= 4 and listener.rows >= 60 and "rows=" in listener.line()


def test_index_is_built_once(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([doc(1, "Việt Nam", ["ｆｕｌｌ.txt"])], DOC)
    monkeypatch.setattr(index, "shared_dir", lambda _: f"file://{tmp_path}")
    words, typos = index.stored(d, "one")
    assert sorted(r.term for r in words.collect()) == ["full", "nam", "txt", "viet"] and typos.where("variant = 'vit'").count() == 1
    monkeypatch.setattr(index, "write", lambda *_: pytest.fail("built again"))
    assert index.stored(d, "one")[0].count() == 4
