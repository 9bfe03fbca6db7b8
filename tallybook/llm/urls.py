"""URL filter: rules first, then a tree of path templates per host.

A path's segments that look variable (numbers, hexadecimal, long or mixed) become wildcards at once. Then every node with many
children turns these into one wildcard, at all depths in one round; a round can bring children of several branches together,
so there are ROUNDS of them. Purity goes down the tree: a branch whose labelled rate does not differ significantly from its
parent's is merged with it (one without labels too), any other has its own rate, shrunk towards its parent's. So labelled
branches speak for unlabelled ones beside them, most for the nearest. A template is rejected when its purity is high enough.
Labels come from the rules' own verdicts or from a column; a host's pages are only ever counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import discard, fresh, lookup_join, materialize

# Fixed values: (verdict, host, path prefix); a rule fits its host and all subdomains, the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Children from which a node has a wildcard, and rounds of that.
MANY, ROUNDS = 24, 3
#: Deviations within which a branch is like its parent; pages' worth of the parent in a branch's rate; purity of a rejected template.
ALIKE, SHRINK, REJECT = 2.0, 2.0, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a segment is replaced by, in order.
SHAPES = ((r"^[0-9]+([.][A-Za-z0-9]{1,5})?$", "<n>"), (r"^[0-9a-fA-F-]{8,}$", "<h>"), (r"^.{40,}$", "<l>"), (r"^.*[0-9].*[0-9].*[0-9].*$", "<m>"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in order]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)]) if order else F.lit(None).cast("string")
    return pick([h + p for _, h, p in order]), pick([v for v, _, _ in order])


def segments(path: Column) -> Column:
    """The shaped segments of a path, at any depth; the empty path has one empty segment."""
    shaped = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(name)) for p, name in SHAPES], x)
    return F.transform(F.split(F.regexp_replace(path, "^/|/$", ""), "/", -1), shaped)


def _nodes(tree: DataFrame, *keep: str) -> DataFrame:
    """A row for each segment of each path: its place k, and `above`, the number of the node it is a child of. Nodes are named
    by a hash of their whole prefix, so a deep path needs no long strings."""
    step = lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x)))
    chain = F.aggregate("segs", F.array(F.xxhash64("host")), step)
    rows = tree.withColumn("above", chain).select(*keep, "path_key", "host", F.posexplode(F.arrays_zip("segs", F.slice("above", F.lit(1), F.size("segs")))).alias("k", "s"))
    return rows.select(*keep, "path_key", "host", "k", F.col("s.segs").alias("seg"), F.col("s.1").alias("above"))


def wildcards(tree: DataFrame, paths: int) -> DataFrame:
    """tree (path_key, host, segs, ...) with * for all children of nodes that have MANY of them."""
    each = materialize(_nodes(tree))
    children = each.where("seg <> ''").groupBy("above", "seg").agg(F.count("*").alias("c")).groupBy("above").agg(F.count("*").alias("children"), F.sum("c").alias("c"))
    wide = materialize(children.where(F.col("children") >= MANY).drop("children").withColumn("wide", F.lit(True)))
    marked = lookup_join(each, wide, ["above"], "c", each.count())
    seg = F.when(F.col("wide") & (F.col("seg") != ""), F.lit("*")).otherwise(F.col("seg"))
    back = marked.groupBy("path_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", seg.alias("s")))), lambda x: x["s"]).alias("segs"))
    out = materialize(tree.drop("segs").join(back, "path_key"))
    discard(each)
    discard(wide)
    return out


def purity(chain: Column) -> Column:
    """Purity of a leaf from (labelled, bad) of the nodes above it and its own, root first, and the depth it was last decided at."""
    rate = lambda x: x["bad"] / x["n"]

    def step(acc: Column, x: Column) -> Column:
        p = acc["p"]
        like = (x["n"] == 0) | (F.abs(rate(x) - p) <= ALIKE * F.sqrt(p * (1 - p) / x["n"]))
        own = F.struct(((x["bad"] + SHRINK * p) / (x["n"] + SHRINK)).alias("p"), (acc["k"] + 1).alias("k"), (acc["k"] + 1).alias("at"))
        return F.when(like, F.struct(p.alias("p"), (acc["k"] + 1).alias("k"), acc["at"].alias("at"))).otherwise(own)

    root = F.get(chain, F.lit(0))
    start = F.struct(((root["bad"] + 1) / (root["n"] + 2)).alias("p"), F.lit(0).alias("k"), F.lit(0).alias("at"))
    return F.aggregate(F.slice(chain, F.lit(2), F.size(chain)), start, step)


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, label_col: str | None = None) -> DataFrame:
    """pages with host, path, rule, template, branch (the part of the template whose labels decided), purity and verdict; columns
    of these names are replaced, all others stay as they are.

    Null urls and those without :// have empty host and path and no rule, and share one template. Repeated rows count as often
    as they stand there. label_col (1 bad, 0 good, null unknown) adds to the rules' verdicts as labels. A purity of REJECT
    itself is rejected.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    made = ("host", "path", "rule", "template", "branch", "purity", "verdict")
    clash = {c for c in pages.columns if c.lower() in made}
    if label_col in clash:
        raise ValueError(f"{label_col} is the name of a result")
    [said, label, key] = fresh(pages, "_said", "_label", "path_key")
    rows = pages.select(*[c for c in pages.columns if c not in clash], host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    mark = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    mark = F.coalesce(mark, F.col(label_col).cast("int")) if label_col else mark
    rows = rows.withColumns({"rule": rule, said: verdict, label: mark, key: F.xxhash64("host", F.array_join(segments(F.col("path")), "/"))})
    known = rows.select("host", F.col("path").alias("p"), F.col(key).alias("path_key"), F.col(label).alias("label"))
    tree = materialize(known.groupBy("path_key").agg(F.first("host").alias("host"), segments(F.first("p")).alias("segs"), F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")))
    paths, total = tree.count(), pages.count()
    for _ in range(ROUNDS):
        later = wildcards(tree, paths)
        discard(tree)
        tree = later
    template = F.array_join("segs", "/")
    leaves = materialize(tree.groupBy("host", template.alias("template")).agg(F.first("segs").alias("segs"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("path_key", F.xxhash64("host", "template")))
    # Each leaf counts for itself and for every node above it.
    each = materialize(_nodes(leaves, "labelled", "bad").unionByName(leaves.select("labelled", "bad", "path_key", "host", F.size("segs").alias("k"), F.lit("").alias("seg"), F.xxhash64(F.lit("leaf"), "path_key").alias("above"))))
    counts = materialize(each.groupBy("above").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("c")))
    joined = lookup_join(each.drop("labelled", "bad"), counts, ["above"], "c", each.count())
    chain = joined.groupBy("path_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n", "bad"))), lambda x: F.struct(x["n"].alias("n"), x["bad"].alias("bad"))).alias("chain"))
    judged = leaves.join(chain.select("path_key", purity(F.col("chain")).alias("found")), "path_key")
    depth = F.col("found.at")
    branch = F.when(depth >= F.size("segs"), F.col("template")).otherwise(F.concat_ws("/", F.array_join(F.slice("segs", F.lit(1), depth), "/"), F.lit("**")))
    judged = judged.select("host", "template", branch.alias("branch"), F.col("found.p").alias("purity"))
    sizes = tree.select("path_key", "host", template.alias("template"), "n")
    verdicts = materialize(sizes.join(judged, ["host", "template"]).select(F.col("path_key").alias(key), "template", "branch", "purity", "n"))
    out = lookup_join(rows, verdicts, [key], "n", total)
    for used in (tree, leaves, each, counts):
        discard(used)
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(F.col(said), method)).drop(said, label, key)


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda of: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{of(v, h, p)}'" for v, h, p in order) + " END"
    shaped = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{name}'" for p, name in SHAPES) + " ELSE x END"
    rounds = ""
    for k in range(ROUNDS):
        rounds += f"""
w{k} AS (SELECT host, prefix FROM (SELECT host, unnest(list_transform(range(len(t)), lambda i: t[1:i])) AS prefix, unnest(t) AS s FROM t{k}) WHERE s <> '' GROUP BY host, prefix HAVING count(DISTINCT s) >= {MANY}),
m{k} AS (SELECT host, list(prefix) AS wide FROM w{k} GROUP BY host),
t{k + 1} AS (SELECT id, host, labelled, bad, CASE WHEN wide IS NULL THEN t ELSE list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] <> '' AND list_contains(wide, t[1:i - 1]) THEN '*' ELSE t[i] END) END AS t FROM t{k} LEFT JOIN m{k} USING (host)),"""
    like = f"x.n = 0 OR abs(x.b / greatest(x.n, 1) - a.p) <= {ALIKE} * sqrt(a.p * (1 - a.p) / greatest(x.n, 1))"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said, list_transform(string_split(regexp_replace(path, '^/|/$', '', 'g'), '/'), lambda x: {shaped}) AS t FROM p),
t0 AS (SELECT page_id AS id, host, (said IS NOT NULL)::BIGINT AS labelled, (said IS NOT NULL AND said = 'block')::BIGINT AS bad, t FROM r),{rounds}
leaf AS (SELECT host, t, sum(labelled) AS n, sum(bad) AS b FROM t{ROUNDS} GROUP BY host, t),
node AS (SELECT host, prefix, false AS own, sum(n) AS n, sum(b) AS b FROM (SELECT host, unnest(list_transform(range(len(t)), lambda i: t[1:i])) AS prefix, n, b FROM leaf) GROUP BY host, prefix UNION ALL SELECT host, t, true, n, b FROM leaf),
above AS (SELECT host, t, unnest(range(len(t) + 1)) AS k FROM leaf),
chain AS (SELECT a.host, a.t, list({{'n': n::DOUBLE, 'b': b::DOUBLE, 'p': (b + 1) / (n + 2)}} ORDER BY k) AS c FROM above a JOIN node ON node.host = a.host AND node.prefix = a.t[1:k] AND own = (k = len(a.t)) GROUP BY a.host, a.t),
j AS (SELECT host, t, list_reduce(c, lambda a, x: {{'n': x.n, 'b': x.b, 'p': CASE WHEN {like} THEN a.p ELSE (x.b + {SHRINK} * a.p) / (x.n + {SHRINK}) END}}).p AS p FROM chain)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN p >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN t{ROUNDS} f ON f.id = page_id JOIN j ON j.host = f.host AND j.t = f.t
"""


ORACLE = _oracle()
