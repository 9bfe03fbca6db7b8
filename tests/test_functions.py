"""Pure functions against fixed vectors."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions import address, codecs, display, text

TREES = st.recursive(st.integers() | st.binary(max_size=9), lambda t: st.lists(t, max_size=4) | st.dictionaries(st.binary(max_size=4), t, max_size=4), max_leaves=12)


def refused(data):
    with pytest.raises(ValueError):
        codecs.bdecode(data)


@settings(max_examples=150, deadline=None)
@given(TREES, st.data())
def test_what_is_cut_or_added_to_is_refused(tree, data):
    good = codecs.bencode(tree)
    refused(good[: data.draw(st.integers(0, len(good) - 1))])
    refused(good + data.draw(st.binary(min_size=1, max_size=3)))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**30), st.sampled_from([b"i0%de", b"i-0%de", b"i+%de", b"i%d", b"i%dx", b"i %de", b"-%d:a", b"%da:b", b"di%dei1ee", b"d1:ki%de1:e"]))
def test_numbers_and_lengths_are_plain(n, form):
    refused(form % n)


@pytest.mark.parametrize("depth", [900, 20_001])
def test_deep_nesting_is_read_or_refused(depth):
    refused(b"l" * depth)
    found = codecs.bdecode(b"l" * depth + b"e" * depth)
    for _ in range(depth - 1):
        (found,) = found
    assert found == []


@pytest.mark.parametrize("value", [True, None, 1.5, object()])
def test_other_types_are_not_encoded(value):
    with pytest.raises(TypeError):
        codecs.bencode([value])


@settings(max_examples=150, deadline=None)
@given(TREES)
def test_bencoding_round_trip(tree):
    assert codecs.bdecode(codecs.bencode(tree)) == tree


def test_bencoding_details():
    assert codecs.bencode({"b": 1, "a": [b"x", -2]}) == b"d1:al1:xi-2ee1:bi1ee"
    assert codecs.bdecode(b"d1:bi1e1:ai2e1:bi3ee") == {b"b": 3, b"a": 2}
    assert codecs.bdecode(b"03:abc") == b"abc"
    assert codecs.bdecode_prefix(b"i7erest") == (7, 3)


def test_codecs_in_frames(spark):
    row = spark.createDataFrame([(b"d1:ki5ee", b"i0"), (None, b"le")], "a binary, b binary").select(codecs.bdecode_json("a").alias("a"), codecs.bdecode_json("b").alias("b")).collect()
    assert json.loads(row[0].a.json) == {"k": 5} and row[0].b.error and row[1].a.json is None and row[1].b.json == "[]"


def test_info_dictionaries():
    one = {"name": "n", "piece length": 16384, "length": 5, "pieces": b""}
    assert codecs.info_summary(codecs.bencode(one))["files"] == [{"path": "n", "length": 5}]
    many = {"name": "n", "name.utf-8": "u", "piece length": 1, "private": 1, "files": [{"length": 2, "path": ["a", "b"]}, {"length": 3, "path": ["c"], "path.utf-8": ["d"]}]}
    found = codecs.info_summary(codecs.bencode(many))
    assert (found["name"], found["total_size"], found["file_count"], found["is_private"]) == ("u", 5, 2, True)
    assert [f["path"] for f in found["files"]] == ["a/b", "d"]
    for change in ({"name": ""}, {"piece length": 0}, {"length": -1}, {"files": []}, {"files": [{"length": 1, "path": "x"}]}):
        assert codecs.info_summary(codecs.bencode(one | change)) == {"error": "bad_info_dict"}
    long = one | {"files": [{"length": 1, "path": [str(k)]} for k in range(250)]}
    found = codecs.info_summary(codecs.bencode(long))
    assert (len(found["files"]), found["file_count"], found["total_size"]) == (200, 250, 250)


def test_sizes_beyond_every_column(spark):
    huge = {"name": "n", "piece length": 16384, "length": 10**40}
    many = huge | {"length": 1, "files": [{"length": 10**38 - 1, "path": ["a"]}] * 2}
    rows = spark.createDataFrame([(codecs.bencode(huge),), (codecs.bencode(many),), (codecs.bencode(huge | {"length": 10**30}),), (None,)], "raw binary").select(codecs.info_summaries("raw").alias("s")).collect()
    assert [r.s.error for r in rows] == ["bad_info_dict", "bad_info_dict", None, "bad_info_dict"]
    assert rows[2].s.total_size == 10**30 and rows[2].s.files[0].length == 2**63 - 1


def test_peer_wire_messages():
    a, b = hashlib.sha1(b"a").digest(), hashlib.sha1(b"b").digest()
    assert codecs.read_handshake(codecs.handshake(a, b)) == (a, b, True)
    with pytest.raises(ValueError):
        codecs.read_handshake(b"x" * 68)
    sent = codecs.extended(3, {"msg_type": 1, "piece": 0}, b"data")
    assert codecs.read_extended(sent[5:]) == (3, {b"msg_type": 1, b"piece": 0}, b"data")
    packet = codecs.pack_utp(4, 7, 1, 2, 3, 65535, 0, b"p")
    assert codecs.read_utp(packet) == {"kind": 4, "connection": 7, "stamp": 1, "difference": 2, "window": 3, "seq": 65535, "ack": 0, "payload": b"p"}
    chained = packet[:1] + bytes([2]) + packet[2:20] + bytes([1, 3, 9, 9, 9, 0, 1, 7]) + b"data"
    assert codecs.read_utp(chained)["payload"] == b"data"
    for bad in (b"", packet[:19], b"\x00" * 20, bytes([5 << 4 | 1]) + packet[1:], chained[:24], chained[:21], chained[:27]):
        with pytest.raises(ValueError, match="bad_packet"):
            codecs.read_utp(bad)


def test_terms_of_any_script(spark):
    texts = ["Árvíztűrő TÜKÖR-fúrógép_x", "Straße 42", "ﬁle Ⅳ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.terms("t").alias("a"), text.terms_exact("t").alias("b")).collect()
    assert list(rows[0].b) == ["arvizturo", "tukor", "furogep", "x"] and rows[0].a == list(rows[0].b)
    assert list(rows[1].b) == ["strasse", "42"] == rows[1].a
    assert list(rows[2].b) == ["file", "iv"]
    assert list(rows[3].b) == [] and rows[4].b is None and rows[4].a is None


def test_both_ways_of_folding_agree(spark):
    letters = "".join(map(chr, [*range(0x20, 0x250), 0x2014, 0x2019, 0x2026, 0xFB01, 0xFF21, 0x301, 0x3A3, 0x3C2, 0x416, 0x1EC7, 0x4E2D, 0xD55C, 0x1F600, 0x1D400]))
    texts = [f"a{c}b {c}" for c in letters] + ["Việt Nam", "Vie\u0323\u0302t", "ｆｕｌｌ", "ﬁle", "Ἀθῆναι", "naïve café", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.terms("t").alias("a")).collect()
    for r in rows:
        assert list(r.a) == text.split_terms(r.t), r.t
    assert text.split_terms("Vie\u0323\u0302t") == text.query_terms("Việt") == ["viet"]


def osa(a, b):
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_one_edit(spark):
    import itertools

    words = ["", *map("".join, itertools.chain(*(itertools.product("abc", repeat=n) for n in (1, 2, 3)))), "ubuntu", "ubunut", "abuntu", "ubunt", "ubuntua"]
    pairs = [(a, b) for a in words for b in words]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.within_one_edit(F.col("a"), F.col("b")).alias("near")).collect()
    assert all(r.near == (osa(r.a, r.b) <= 1) for r in found)


def test_requests():
    assert address.parse_search({"q": "  x ", "limit": "999"}) == {"query": "x", "limit": 200, "sort": None, "order": "desc"}
    assert address.parse_search({"limit": "x", "sort": "name"})["order"] == "asc" and address.parse_search({"limit": "-3"})["limit"] == 1
    assert address.parse_search({"sort": "bad", "order": "asc"}) == {"query": "", "limit": 20, "sort": None, "order": "asc"}
    assert len(address.parse_search({"q": "a" * 300})["query"]) == 200
    assert address.parse_hash("AB" * 20) == "ab" * 20 and address.parse_hash("g" * 40) is None and address.parse_hash("ab") is None


def test_addresses(spark):
    cases = {("8.8.8.8", 53): True, ("01.2.3.4", 1): True, ("10.0.0.1", 80): False, ("172.32.0.1", 80): True, ("172.31.0.1", 80): False, ("192.0.1.1", 80): True, ("192.88.99.5", 80): False, ("224.0.0.1", 80): False, ("256.1.1.1", 80): False, ("1.2.3", 80): False, ("1.2.3.4.5", 80): False, ("8.8.8.8", 0): False, ("8.8.8.8", 65536): False, ("0001.2.3.4", 80): False, ("2a00:1450::1", 80): True, ("2001:db8::1", 80): False, ("::ffff:8.8.8.8", 80): False, ("ff02::1", 80): False, ("2a00::zz", 80): False}
    rows = spark.createDataFrame([(i, p) for i, p in cases], "ip string, port int").select("ip", "port", address.is_routable(F.col("ip"), F.col("port")).alias("ok")).collect()
    assert {(r.ip, r.port): r.ok for r in rows} == cases


def test_display(spark):
    numbers = {0: ("0 B", "0", "0"), 999: ("999 B", "999", "999"), 1000: ("1000 B", "1k", "1 000"), 1023: ("1023 B", "1k", "1 023"), 1536: ("1.5 KiB", "1.5k", "1 536"), 999949: ("976.5 KiB", "999.9k", "999 949"), 999999: ("976.6 KiB", "1M", "999 999"), 1234567890: ("1.1 GiB", "1.2B", "1 234 567 890"), 2**63 - 1: ("8.0 EiB", "9223372T", "9 223 372 036 854 775 807")}
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", *[f(F.col("n")) for f in (display.format_bytes, display.format_count, display.format_full)]).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} | {2**63 - 1: 0} == numbers | {2**63 - 1: 0}
    odd = {None: ("0 B", "0", "0"), 12.0: ("12 B", "12", "12"), 999.6: ("1000 B", "1k", "1 000")}
    rows = spark.createDataFrame([(n,) for n in odd], "n double").select("n", *[f(F.col("n")) for f in (display.format_bytes, display.format_count, display.format_full)], display.full_if_different(F.col("n"))).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} == odd and [r[4] for r in rows] == [None, None, "1 000"]
    times = {0: "0s", 59: "59s", 60: "1m 0s", 3661: "1h 1m 1s", 86400: "1d 0h 0m 0s", 93784: "1d 2h 3m 4s"}
    rows = spark.createDataFrame([(n,) for n in times], "n long").select("n", display.format_duration(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == times


def test_links(spark):
    from urllib.parse import quote

    names = ["a b&c", "~x*y", "é/ü", "", None]
    rows = spark.createDataFrame([("ab" * 20, n) for n in names], "h string, n string").select("n", display.magnet_link(F.col("h"), F.col("n")).alias("l")).collect()
    for r in rows:
        assert r.l == "magnet:?xt=urn:btih:" + "ab" * 20 + (f"&dn={quote(r.n, safe='')}" if r.n else "") + display.LINK_END
    assert display.LINK_END.count("&tr=") == 20


def test_compact_records(spark):
    raw = codecs.pack_address("8.8.4.4", 6881)
    six = codecs.pack_address("2a00:1450::1", 80)
    row = spark.createDataFrame([(raw, six, b"12345", None)], "a binary, b binary, c binary, d binary").select(codecs.compact_ip4(F.col("a")).alias("ip"), codecs.compact_port(F.col("a")).alias("port"), codecs.compact_ip6("b").alias("ip6"), codecs.compact_port(F.col("b"), 18).alias("port6"), codecs.cut(F.col("c"), 2).alias("cut"), codecs.cut(F.col("d"), 2).alias("none")).first()
    assert (row.ip, row.port, row.ip6, row.port6) == ("8.8.4.4", 6881, "2a00:1450::1", 80)
    assert [bytes(x) for x in row.cut] == [b"12", b"34"] and row.none == []


def test_identifiers(spark):
    nodes = [(bytes(range(20)), "8.8.4.4", 6881), (bytes(20), "1.2.3.4", 1)]
    raw = codecs.pack_nodes(nodes)
    assert len(raw) == 2 * codecs.NODE4 and raw[:20] == nodes[0][0] and raw[46:] == bytes([1, 2, 3, 4, 0, 1])
    rows = spark.range(50).select(codecs.random_ids(F.col("id")).alias("a"), codecs.random_ids(F.col("id"), 20, b"-TB0001-").alias("b"), codecs.random_ids(F.col("id"), 2).alias("c")).collect()
    assert len({bytes(r.a) for r in rows}) == len({bytes(r.b) for r in rows}) == 50 and {(len(r.a), len(r.b), len(r.c)) for r in rows} == {(20, 20, 2)}
    assert all(bytes(r.b).startswith(b"-TB0001-") for r in rows)


def test_compact_peers(spark):
    four, six = codecs.pack_address("8.8.4.4", 1), codecs.pack_address("2a00:1450::1", 2)
    row = spark.createDataFrame([([four, six, b"short", None],)], "v array<binary>").select(codecs.peers_of(F.col("v")).alias("four"), codecs.peers_of(F.col("v"), codecs.ADDRESS6).alias("six")).first()
    assert [bytes(x) for x in row.four] == [four] and [bytes(x) for x in row.six] == [six]


def test_foreign_nodes(spark):
    import hashlib as h

    own, other = h.sha1(b"own").digest(), h.sha1(b"other").digest()
    rows = [(other, "8.8.8.8", 1, True), (own, "8.8.8.8", 1, False), (other[:19], "8.8.8.8", 1, False), (other, "10.0.0.1", 1, False), (other, "2a00:1450::1", 1, False)]
    found = spark.createDataFrame(rows, "id binary, ip string, port int, want boolean").select("want", address.is_foreign(F.col("id"), F.col("ip"), F.col("port"), [own[15:]]).alias("is")).collect()
    assert all(r["is"] == r.want for r in found)


def test_global_ip6_as_the_library_says(spark):
    import ipaddress

    ips = ["2a00:1450::1", "2001::1", "2001:1::1", "2001:1::2", "2001:3::9", "2001:4:112::1", "2001:20::1", "2001:2f::1", "2001:30::1", "2001:200::1", "2001:db8::1", "2002::1", "3fff::1", "3fff:fff::1", "4000::1", "1fff::1", "::1", "fe80::1", "ff0e::1", "::ffff:8.8.8.8", "64:ff9b::1", "x", ""]

    def want(ip):
        try:
            x = ipaddress.IPv6Address(ip)
        except ValueError:
            return False
        return x.is_global and ip[:1] in "23"

    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", address.is_global_ip6("ip").alias("ok")).collect()
    assert {r.ip: r.ok for r in rows} == {i: want(i) for i in ips}


def test_tokens(spark):
    import hmac

    row = spark.createDataFrame([("1.2.3.4", b"secret")], "ip string, s binary").select(codecs.token("ip", "s").alias("t")).first()
    assert bytes(row.t) == hmac.new(b"secret", b"1.2.3.4", hashlib.sha1).digest()[:8]
