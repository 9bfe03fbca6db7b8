"""Secret scan with multipart credential linking, in DataFrame functions only.

Every text keeps its own list of spans. Base kinds stand alone; weak kinds (identifiers, long opaque values, endpoints)
are reported only where a complementary part lies in the same scope: the interval join of weak spans, widened by `scope`
characters on both sides, with parts of other roles. The join is a sweep in each direction over the text's spans in order,
which carries the furthest end (or nearest start) of each role, so its cost follows the spans and not their pairs; so does the
test of weak spans against base ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fresh

# The base kinds' patterns, as the contract words them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds.
IDENT = r"""(?i)(access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9._:/-]+"

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = 3
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "opaque": "secret", "endpoint": "endpoint"}
#: What has to be near a weak part of a role.
PARTNERS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
SCOPE = 256

_SPAN = "struct<start:int,kind:int,end:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"


#: Elements of a growing list that are copied when one is added.
STRIDE = 256


def _fold(items: Column, state: str, kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """Elements that a fold over items adds one by one. step(state, item) gives the state's new fields, the element and whether
    it counts. The list grows in strides, so a text with very many matches costs no square of them."""
    zero = F.expr(f"named_struct({state}, 'done', cast(array() as array<array<{kind}>>), 'last', cast(array() as array<{kind}>))")

    def run(acc: Column, x: Column) -> Column:
        fields, element, counts = step(acc, x)
        full = F.size(acc["last"]) >= STRIDE
        done = F.when(counts & full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
        last = F.when(~counts, acc["last"]).when(full, F.array(element)).otherwise(F.concat(acc["last"], F.array(element)))
        return F.struct(*[v.alias(k) for k, v in fields.items()], done.alias("done"), last.alias("last"))

    return F.aggregate(items, zero, run, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]))))


def _spans(text: Column, pattern: str, kind: int, maybe: Column, group: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches: gaps between them and their lengths add up to code points."""
    parts = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        start = acc["at"] + F.char_length(x["0"])
        end = start + F.char_length(F.coalesce(x["1"], F.lit("")))
        counts = x["1"].isNotNull() & (F.char_length(x["2"]) >= least) if group else x["1"].isNotNull()
        return {"at": end}, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")), counts

    # A transform names the zipped fields by their place.
    zipped = F.transform(F.arrays_zip(*[F.transform(p, lambda v: v) for p in parts]), lambda v: v)
    return F.when(maybe, _fold(zipped, "'at', 0", _SPAN, step)).otherwise(F.expr(_NONE))


def _overlapped(spans: Column, forward: bool) -> Column:
    """Per span of a sorted list, whether it overlaps a base span that comes before it in the sweep's direction."""

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        base = s["kind"] < BASE
        edge = F.when(base, F.greatest(acc["edge"], s["end"]) if forward else F.least(acc["edge"], s["start"])).otherwise(acc["edge"])
        return {"edge": edge}, (acc["edge"] > s["start"]) if forward else (acc["edge"] < s["end"]), F.lit(True)

    found = _fold(spans if forward else F.reverse(spans), f"'edge', {-(10**9) if forward else 2 * 10**9}", "boolean", step)
    return found if forward else F.reverse(found)


_NEAR = "array<struct<role:string,start:int,kind:int,end:int>>"


def _partners(spans: Column, forward: bool) -> Column:
    """Per span of a sorted list, the part of each role that came before it (in the sweep's direction) and reaches closest, if
    that is within scope."""
    roles = sorted(PARTNERS)
    role_of = F.expr("array(" + ", ".join(f"'{ROLES[k]}'" for k in KINDS) + ")")
    far = -(10**9) if forward else 2 * 10**9
    state = ", ".join(f"'{r}', named_struct('edge', {far}, 'other', {far}, 'kind', 0)" for r in roles)

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        role = F.element_at(role_of, s["kind"] + 1)
        near, fields = [], {}
        for r in roles:
            part = F.struct((acc[r]["other"] if forward else acc[r]["edge"]).alias("start"), acc[r]["kind"].alias("kind"), (acc[r]["edge"] if forward else acc[r]["other"]).alias("end"))
            close = acc[r]["edge"] > s["start"] - SCOPE if forward else acc[r]["edge"] < s["end"] + SCOPE
            near.append(F.when(close, F.struct(F.lit(r).alias("role"), part["start"].alias("start"), part["kind"].alias("kind"), part["end"].alias("end"))))
            own = F.struct((s["end"] if forward else s["start"]).alias("edge"), (s["start"] if forward else s["end"]).alias("other"), s["kind"].alias("kind"))
            fields[r] = F.when(role == r, F.greatest(acc[r], own) if forward else F.least(acc[r], own)).otherwise(acc[r])
        return fields, F.filter(F.array(*near), lambda x: x.isNotNull()), F.lit(True)

    found = _fold(spans if forward else F.reverse(spans), state, _NEAR, step)
    return found if forward else F.reverse(found)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", links: str | None = None) -> DataFrame:
    """docs with a column `out`: array of (start, kind number, end) of all spans reported, in order; and with a column `links`,
    if it is named: of each weak span reported, the closest complementary part on either side.

    Null texts count as empty and have none. Repeated rows are judged each for itself. Of spans of weak kinds, those that
    overlap a base span are dropped, and those without a partner in scope are not reported. Columns of the names given are
    replaced, all others stay as they are.
    """
    names = fresh(docs, "_text", "_low", "_base", "_weak", "_sorted", "_parts", "_near")
    text_, low_, base_, weak_, sorted_, parts_, near_ = names
    text, low = F.col(text_), F.col(low_)
    has = lambda *words: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
    found = docs.withColumn(text_, F.coalesce(F.col(text_col), F.lit(""))).withColumn(low_, F.lower(text)).withColumns(
        {
            base_: F.concat(
                _spans(text, ASSIGN, 0, has("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
                _spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
                _spans(text, HEX, 2, text.rlike(HEX)),
            ),
            weak_: F.concat(
                _spans(text, IDENT, 3, has("accesskey", "access_key", "clientid", "client_id", "username", "user_name", "login")),
                _spans(text, OPAQUE, 4, text.rlike(OPAQUE)),
                _spans(text, ENDPOINT, 5, has("http://", "https://")),
            ),
        }
    )
    some = F.size(weak_) > 0
    found = found.withColumn(sorted_, F.array_sort(F.concat(base_, weak_)))
    hidden = F.zip_with(_overlapped(F.col(sorted_), True), _overlapped(F.col(sorted_), False), lambda a, b: a | b)
    alone = F.filter(F.arrays_zip(F.col(sorted_).alias("s"), hidden.alias("h")), lambda x: (x["s"]["kind"] < BASE) | ~x["h"])
    found = found.withColumn(parts_, F.when(some, F.transform(alone, lambda x: x["s"])).otherwise(F.col(sorted_)))
    both = F.zip_with(_partners(F.col(parts_), True), _partners(F.col(parts_), False), lambda a, b: F.concat(a, b))
    needs = F.expr("array(" + ", ".join("array(" + ", ".join(f"'{p}'" for p in PARTNERS[ROLES[k]]) + ")" for k in KINDS) + ")")
    fitting = F.zip_with(F.col(parts_), both, lambda s, near: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.filter(near, lambda x: F.array_contains(F.element_at(needs, s["kind"] + 1), x["role"])).alias("near")))
    found = found.withColumn(near_, F.when(some, F.filter(fitting, lambda x: (x["kind"] < BASE) | (F.size(x["near"]) > 0))))
    plain = F.transform(near_, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    spans = F.when(some, plain).otherwise(F.col(parts_))
    added = {out: spans}
    if links:
        added[links] = F.coalesce(F.filter(near_, lambda x: x["kind"] >= BASE), F.expr(f"cast(array() as array<struct<start:int,kind:int,end:int,near:{_NEAR}>>)"))
    return found.withColumns(added).drop(*[n for n in names if n not in added])


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.expr("array(" + ", ".join(f"'{k}'" for k in KINDS) + ")")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        return {"at": F.greatest(acc["at"], s["end"])}, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)), s["start"] >= acc["at"]

    pieces = F.array_join(_fold(spans, "'at', 0", "string", step), "")
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(pieces, F.substring(text, end + 1, F.char_length(text)))).otherwise(text)


_ORACLE_PARTS = "\nUNION ALL\n".join(
    f"""SELECT doc_id, {k} AS kind, start, start + length(hit) AS stop FROM (
  SELECT doc_id, hit, value, (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS start FROM (
    SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, $q${p}$q$, 0) AS hits, regexp_extract_all(t, $q${p}$q$, {g}) AS vals, string_split_regex(t, $q${p}$q$) AS gaps FROM d)
  ) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
WHERE length(value) >= {n}"""
    for k, (p, g, n) in enumerate([(ASSIGN, 2, 6), (ACCESS, 0, 20), (HEX, 0, 24), (IDENT, 0, 0), (OPAQUE, 0, 0), (ENDPOINT, 0, 0)])
)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({_ORACLE_PARTS}),
q AS (SELECT *, CASE kind WHEN 1 THEN 'id' WHEN 3 THEN 'id' WHEN 5 THEN 'endpoint' ELSE 'secret' END AS part FROM p a
  WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.kind < 3 AND b.start < a.stop AND a.start < b.stop)),
s AS (SELECT *, {"CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"} || ':' || start || ':' || stop AS said FROM q a
  WHERE kind < 3 OR EXISTS (SELECT 1 FROM q b WHERE b.doc_id = a.doc_id AND b.start < a.stop + {SCOPE} AND b.stop > a.start - {SCOPE}
    AND CASE a.part WHEN 'id' THEN b.part = 'secret' WHEN 'secret' THEN b.part IN ('id', 'endpoint') ELSE b.part IN ('id', 'secret') END)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
