"""Registered queries: QUERIES by name, ORACLE the SQL of each where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as ft
from lodeworks.operators import clones, closure, entropy, findings, relations
from lodeworks.operators.graph import connected_components
from lodeworks.plans import inputs, rule_queries
from lodeworks.plans.inputs import FINDINGS_SQL, FOREST_SQL, LINES_SQL, NS_SQL
from lodeworks.plans.rule_queries import NUMBERED_SQL, numbered
from lodeworks.sinks.reports import CATEGORIES
from lodeworks.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(rule_queries.QUERIES)
ORACLE: dict[str, str] = dict(rule_queries.ORACLE)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- clones

W = 12
SEEDS_SQL = f"""tok AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[ \\t\\n\\r]+') IF x <> ''] AS t FROM documents),
win AS (SELECT doc_id, i - 1 AS idx, array_to_string(list_slice(t, i, i + {W - 1}), chr(31)) AS k FROM (SELECT doc_id, t, unnest(range(1, len(t) - {W - 2})) AS i FROM tok WHERE len(t) >= {W})),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, idx) AS r, min(doc_id) OVER (PARTITION BY k) AS a, max(doc_id) OVER (PARTITION BY k) AS b FROM win) WHERE r <= 512 AND a < b),
pr AS (SELECT l.doc_id AS l_path, r.doc_id AS r_path, l.idx AS l_idx, r.idx AS r_idx FROM cut l JOIN cut r ON l.k = r.k AND l.doc_id < r.doc_id),
isl AS (SELECT l_path, r_path, CAST(min(l_idx) AS BIGINT) AS l_start, CAST(min(r_idx) AS BIGINT) AS r_start, count(*) + {W - 1} AS len
  FROM (SELECT *, l_idx - row_number() OVER (PARTITION BY l_path, r_path, r_idx - l_idx ORDER BY l_idx) AS g FROM pr) GROUP BY l_path, r_path, r_idx - l_idx, g),
mx AS (SELECT l_path, r_path, l_start, r_start, len FROM (SELECT *, max(r_start + len) OVER (PARTITION BY l_path, r_path ORDER BY len DESC, l_start, r_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM isl)
  WHERE far IS NULL OR r_start + len > far)"""


def _tokens():
    return F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")


def _islands(s: SparkSession, d: str) -> DataFrame:
    found = clones.islands(clones.windows(table(s, d, "documents").dropna(subset=["text"]), "doc_id", _tokens(), W), W)
    return found.withColumns({"l_start": F.col("l_start").cast("bigint"), "r_start": F.col("r_start").cast("bigint")})


@query(f"WITH {SEEDS_SQL} SELECT * FROM isl")
def clone_pairs(s, d):
    return _islands(s, d)


@query(f"WITH {SEEDS_SQL} SELECT * FROM mx")
def clone_maximal(s, d):
    return clones.maximal(_islands(s, d))


SETS_SQL = f"""WITH RECURSIVE {SEEDS_SQL},
fr AS (SELECT DISTINCT l_path AS path, l_start AS start, len FROM mx UNION SELECT DISTINCT r_path, r_start, len FROM mx),
ed AS (SELECT {{'path': l_path, 'start': l_start, 'len': len}} AS a, {{'path': r_path, 'start': r_start, 'len': len}} AS b FROM mx),
sy AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT a AS node, a AS root FROM sy UNION SELECT sy.b, reach.root FROM reach JOIN sy ON sy.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
mem AS (SELECT c.path AS set_path, c.start AS set_start, c.len AS set_len, node.path AS path, min(node.start) AS start, max(node.start + node.len) AS stop FROM comp GROUP BY c, node.path)"""


@query(f"{SETS_SQL} SELECT * FROM mem")
def clone_sets(s, d):
    return clones.members(clones.maximal(_islands(s, d)))


@query(
    f"""{SETS_SQL}, sz AS (SELECT set_path, set_start, set_len, count(DISTINCT path) AS files, count(DISTINCT lower(source)) AS folders FROM mem JOIN documents ON doc_id = path GROUP BY ALL)
SELECT * FROM sz WHERE files >= 2 AND folders >= 2"""
)
def clone_findings(s, d):
    sets = clones.members(clones.maximal(_islands(s, d)))
    return clones.spread(sets, table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("folder")))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_contained(s, d):
    # a piece of the item meets the documents' pieces before the substring is looked for
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("item")).where("item is not null")
    docs = table(s, d, "documents").select("doc_id", "text").where("text is not null")
    # the longest inner word of the item is surely whole in any text that contains it; an item without one is met by its first characters
    parts = F.split("item", "[ \\n]+")
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")
    b = b.withColumn("w", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\n]+"))).alias("w"))
    met = words.join(b.where("w is not null").select("item_id", "w"), "w").select("item_id", "doc_id")
    out = met.join(docs, "doc_id").join(b, "item_id").where(F.contains("text", "item")).select("item_id", "doc_id")
    bare = b.where("w is null")
    if not bare.isEmpty():
        grams = lambda n: docs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).alias("g"))
        for n in (1, 2, 3):
            some = bare.where(F.length("item") == n if n < 3 else F.length("item") >= n).withColumn("g", F.substring("item", 1, n))
            out = out.union(grams(n).join(some, "g").where(F.contains("text", "item")).select("item_id", "doc_id"))
        out = out.union(docs.join(F.broadcast(bare.where("item = ''")), F.contains("text", "item")).select("item_id", "doc_id"))
    return out


@query(
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents)
SELECT name, count(*) AS docs, min(doc_id) AS first_doc FROM w GROUP BY name"""
)
def identifier_index(s, d):
    w = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("name"))
    return w.groupBy("name").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


# ---------------------------------------------------------------- joins


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unreferenced_anti(s, d):
    return relations.unreferenced(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id")


@query(
    """SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_totalprice > 1000)
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"""
)
def unreferenced_scoped(s, d):
    o = table(s, d, "orders")
    spelled = o.where("o_totalprice > 1000").select(F.col("o_orderpriority").alias("name")).distinct()
    named = relations.scoped_candidates(o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name")), spelled)
    return relations.unreferenced(named, table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").drop("name")


@query(
    """SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)
AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5))"""
)
def unused_with_evidence(s, d):
    li = table(s, d, "lineitem")
    used = li.where("l_returnflag = 'R' and l_quantity < 5").select("l_orderkey")
    return relations.unused_with_evidence(table(s, d, "part").select("p_partkey"), li.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey"), used, "p_partkey", "l_orderkey")


@query(
    """SELECT DISTINCT l_orderkey AS symbol_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"""
)
def contract_rescue(s, d):
    impl = table(s, d, "lineitem").select(F.col("l_orderkey").alias("symbol_id"), F.col("l_suppkey").alias("contract_symbol_id"))
    return relations.contract_live(impl, table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol_id")))


@query("SELECT l_orderkey, count(*) AS uses FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_discount < 0.05)")
def all_uses_direct(s, d):
    return relations.all_uses(table(s, d, "lineitem"), "l_orderkey", F.col("l_discount") < 0.05)


@query("SELECT user_id, count(*) AS uses FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'view' AND value > 90)")
def write_only(s, d):
    return relations.written_not_read(table(s, d, "events"), "user_id", F.col("event_type") == "purchase", (F.col("event_type") == "view") & (F.col("value") > 90))


@query("SELECT l_orderkey, count(*) AS places FROM (SELECT l_orderkey, l_linestatus, bool_or(l_quantity >= 10) AS ok FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING bool_and(ok)")
def inbox_everywhere(s, d):
    return closure.everywhere(table(s, d, "lineitem").withColumn("ok_", F.col("l_quantity") >= 10), ["l_orderkey"], ["l_linestatus"], "ok_")


@query("SELECT l_suppkey, count(*) AS places FROM (SELECT l_suppkey, l_returnflag, l_linestatus, bool_or(l_tax >= 0.07) AS ok FROM lineitem GROUP BY ALL) GROUP BY l_suppkey HAVING bool_and(ok)")
def redundant_everywhere(s, d):
    return closure.everywhere(table(s, d, "lineitem").withColumn("ok_", F.col("l_tax") >= 0.07), ["l_suppkey"], ["l_returnflag", "l_linestatus"], "ok_")


@query(f"WITH {FOREST_SQL} SELECT p_partkey AS node, coalesce(n, 0) AS inbound FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM forest GROUP BY dst) g ON dst = p_partkey WHERE coalesce(n, 0) = 0")
def inbound_zero(s, d):
    n = inputs.forest(s, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    return table(s, d, "part").select(F.col("p_partkey").alias("node")).join(n, "node", "left").select("node", F.coalesce("inbound", F.lit(0)).cast("bigint").alias("inbound")).where("inbound = 0")


# ---------------------------------------------------------------- graphs

REACH_SQL = f"WITH RECURSIVE {FOREST_SQL}, r AS (SELECT src AS root, dst AS node, 1 AS depth FROM forest UNION ALL SELECT r.root, f.dst, r.depth + 1 FROM r JOIN forest f ON f.src = r.node)"


@query(f"{REACH_SQL} SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node")
def transitive_closure(s, d):
    return closure.closure(inputs.forest(s, d))


@query(
    f"""WITH RECURSIVE {FOREST_SQL}, r AS (SELECT src AS root, dst AS node, go, 1 AS depth FROM forest UNION ALL SELECT r.root, f.dst, f.go, r.depth + 1 FROM r JOIN forest f ON f.src = r.node WHERE r.go)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node"""
)
def consumers_closure(s, d):
    return closure.closure(inputs.forest(s, d), onward="go")


@query(f"{REACH_SQL}, x AS (SELECT DISTINCT root, node FROM r) SELECT min(root) AS root, node FROM x GROUP BY node HAVING count(*) = 1")
def exclusive_subtree(s, d):
    f = inputs.forest(s, d)
    return closure.exclusive_subtree(f.select("src", "dst"), f.select(F.col("src").alias("root")))


@query(f"{REACH_SQL}, e AS (SELECT root, node FROM r UNION SELECT src, src FROM forest) SELECT e.root, f.dst AS node, max(f.version) AS required FROM e JOIN forest f ON f.src = e.node GROUP BY e.root, f.dst")
def strongest_requirement(s, d):
    return closure.strongest_requirement(inputs.forest(s, d), "version")


@query(
    f"""{REACH_SQL}, flow AS (SELECT DISTINCT root, node FROM r),
keep AS (SELECT DISTINCT root, node FROM r WHERE EXISTS (SELECT 1 FROM forest f WHERE f.src = r.root AND f.go)),
used AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_returnflag = 'R')
SELECT root, node FROM flow WHERE node IN (SELECT node FROM used) AND (root, node) NOT IN (SELECT (root, node) FROM keep)"""
)
def flow_surviving(s, d):
    f = inputs.forest(s, d)
    # a root with an edge that goes on keeps all it reaches, so only the others are walked from
    going = f.where("go").select(F.col("src").alias("root")).distinct()
    roots = f.select(F.col("src").alias("root")).distinct().join(going.hint("merge"), "root", "left_anti")
    used = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("node")).distinct()
    return closure.closure(f, roots=roots).join(used.hint("merge"), "node", "left_semi").select("root", "node")


@query(f"{REACH_SQL} SELECT n.node AS member, min(n.root) AS family FROM (SELECT root AS node, node AS root FROM r UNION SELECT src, src FROM forest UNION SELECT dst, dst FROM forest) n GROUP BY n.node")
def override_family(s, d):
    # of a forest the component's smallest node is its root
    parts = connected_components(inputs.forest(s, d), "src", "dst")
    return parts.select(F.col("node").alias("member"), F.col("component").alias("family"))


@query(
    f"""WITH RECURSIVE {FOREST_SQL}, r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1 UNION ALL SELECT f.dst, r.depth + 1 FROM r JOIN forest f ON f.src = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""
)
def discovered_fixpoint(s, d):
    seeds = table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return closure.fixpoint(seeds, inputs.forest(s, d))


@query(
    """WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS a FROM pages),
g AS (SELECT host, min(a) AS lo, max(a) AS hi, least(min(len(a)), max(len(a))) AS n FROM p GROUP BY host),
q AS (SELECT host, lo, hi, least(len(lo), len(hi)) - 1 AS m FROM g)
SELECT host, array_to_string(list_slice(lo, 1, (SELECT max(k) FROM unnest(range(0, m + 1)) AS u(k) WHERE list_slice(lo, 1, k) = list_slice(hi, 1, k))), '/') AS folder FROM q"""
)
def common_root(s, d):
    p = table(s, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    # the smallest and the largest path agree as far as all do: two rows a group, whatever its size
    ends = p.groupBy("host").agg(F.min(F.split("path", "/")).alias("a"), F.max(F.split("path", "/")).alias("b"))
    return ends.select("host", ft.common_folder(F.array(F.array_join("a", "/"), F.array_join("b", "/"))).alias("folder"))


# ---------------------------------------------------------------- intervals and history


@query(
    """WITH s AS (SELECT l_orderkey, min(l_linenumber) AS a, min(l_linenumber) + 2 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT s.l_orderkey, count(*) AS inside FROM s JOIN lineitem p ON p.l_orderkey = s.l_orderkey AND p.l_linenumber BETWEEN s.a AND s.b GROUP BY s.l_orderkey"""
)
def interval_contains(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    spans = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a")).withColumn("b", F.col("a") + 2)
    return relations.contained(spans, li, ["l_orderkey"], "a", "b", "l_linenumber").groupBy("s.l_orderkey").agg(F.count("*").alias("inside"))


HUNK_SQL = """WITH reg AS (SELECT l_orderkey AS path, CAST(l_linenumber * 10 AS INTEGER) AS a, CAST(l_linenumber * 10 + l_quantity AS INTEGER) AS b FROM lineitem WHERE l_linenumber <= 3),
h AS (SELECT l_orderkey AS path, CAST(l_linenumber * 12 AS INTEGER) AS hs, CAST(l_quantity % 7 AS INTEGER) AS hc FROM lineitem WHERE l_linestatus = 'O')"""


def _regions(s, d):
    li = table(s, d, "lineitem")
    reg = li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 10).cast("int").alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("b"))
    h = li.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 12).cast("int").alias("hs"), (F.col("l_quantity") % 7).cast("int").alias("hc"))
    return reg, h


@query(f"{HUNK_SQL} SELECT reg.path, a, b, hs, hc FROM reg JOIN h ON reg.path = h.path AND hs + greatest(hc, 1) - 1 >= a - 1 AND hs <= b + 1")
def region_touch(s, d):
    reg, h = _regions(s, d)
    return reg.join(h, "path").where(relations.touches(F.col("a"), F.col("b"), F.col("hs"), F.col("hc")))


@query(
    """WITH reg AS (SELECT l_orderkey AS path, min(l_linenumber) * 10 AS a, max(l_linenumber) * 10 AS b, min(CAST(l_quantity AS INTEGER)) AS hs, list_sort(list(CAST(l_quantity AS INTEGER))) AS ls FROM lineitem GROUP BY l_orderkey)
SELECT path, CAST(coalesce(list_min([x FOR x IN ls IF x BETWEEN a AND b]), ls[list_position([abs(x - a) FOR x IN ls], list_min([abs(x - a) FOR x IN ls]))], least(greatest(hs, a), b)) AS INTEGER) AS anchor FROM reg"""
)
def anchor_line(s, d):
    q = F.col("l_quantity").cast("int")
    g = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg((F.min("l_linenumber") * 10).alias("a"), (F.max("l_linenumber") * 10).alias("b"), F.min(q).alias("hs"), F.sort_array(F.collect_list(q)).alias("ls"))
    return g.select("path", relations.anchor_line(F.col("a"), F.col("b"), F.col("ls"), F.col("hs")).alias("anchor"))


COMMITS_SQL = """cf AS (SELECT user_id AS path, b AS sha, ord FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS b FROM events) JOIN (SELECT b, row_number() OVER (ORDER BY b DESC) - 1 AS ord FROM (SELECT DISTINCT date_trunc('hour', ts) AS b FROM events)) USING (b)),
last AS (SELECT path, sha, ord FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM cf) WHERE r = 1)"""


def _commits(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("path"), F.date_trunc("hour", "ts").alias("sha")).distinct()
    # log positions: a row for each hour of the log
    order = e.select("sha").distinct().withColumn("ord", (F.row_number().over(Window.orderBy(F.desc("sha"))) - 1).cast("bigint"))
    return e.join(order, "sha").select("path", "sha", "ord")


@query(f"WITH {COMMITS_SQL} SELECT path, sha, ord FROM last")
def last_commit(s, d):
    return relations.newest(_commits(s, d), "path", "ord")


@query(
    f"""WITH {COMMITS_SQL}, m AS (SELECT path, path // 4 AS set_id, sha, ord FROM last)
SELECT m.set_id, m.path, m.sha FROM m WHERE NOT EXISTS (SELECT 1 FROM cf JOIN last o ON o.path = cf.path WHERE cf.sha = m.sha AND cf.path // 4 = m.set_id AND cf.path <> m.path)"""
)
def one_sided_change(s, d):
    c = _commits(s, d)
    m = relations.newest(c, "path", "ord").withColumn("set_id", F.expr("path div 4"))
    other = c.select(F.expr("path div 4").alias("set_id"), "sha", F.col("path").alias("o"))
    return m.join(other, (m["set_id"] == other["set_id"]) & (m["sha"] == other["sha"]) & (m["path"] != other["o"]), "left_anti").select("set_id", "path", "sha")


@query(
    f"""WITH {COMMITS_SQL} SELECT a.path, count(*) AS catch_ups, string_agg(CAST(b.path AS VARCHAR), ',' ORDER BY b.path) AS siblings FROM last a JOIN last b ON a.path // 4 = b.path // 4 AND b.ord < a.ord GROUP BY a.path"""
)
def catch_up(s, d):
    last = relations.newest(_commits(s, d), "path", "ord").withColumn("set_id", F.expr("path div 4"))
    a, b = last.alias("a"), last.alias("b")
    j = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("b.ord") < F.col("a.ord")))
    return j.groupBy("a.path").agg(F.count("*").alias("catch_ups"), F.array_join(F.transform(F.sort_array(F.collect_list("b.path")), lambda x: x.cast("string")), ",").alias("siblings"))


@query(
    f"""WITH {COMMITS_SQL} SELECT path, ord FROM last a WHERE NOT EXISTS (SELECT 1 FROM last b JOIN events e ON e.user_id = b.path AND e.event_type = 'purchase' WHERE b.path // 4 = a.path // 4 AND b.ord > a.ord)"""
)
def fixed_earlier(s, d):
    last = relations.newest(_commits(s, d), "path", "ord").withColumn("set_id", F.expr("path div 4"))
    fixes = last.join(table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("path")).distinct(), "path", "left_semi")
    b = fixes.select(F.col("set_id").alias("s2"), F.col("ord").alias("o2"))
    return last.join(b, (F.col("set_id") == F.col("s2")) & (F.col("o2") > F.col("ord")), "left_anti").select("path", "ord")


# ---------------------------------------------------------------- text


@query(
    f"""WITH {LINES_SQL}, rep AS (SELECT text FROM lines WHERE text <> '' GROUP BY text HAVING count(DISTINCT doc_id) >= 2),
fl AS (SELECT doc_id, line, lines.text AS text, rep.text IS NOT NULL AS flag FROM lines LEFT JOIN rep ON rep.text = lines.text),
isl AS (SELECT doc_id, line, flag, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM fl WHERE text <> ''),
b AS (SELECT doc_id, min(line) AS start, max(line) AS stop, count(*) AS lines, avg(CASE WHEN flag THEN 1.0 ELSE 0 END) AS share FROM isl GROUP BY doc_id, g)
SELECT doc_id, start, stop, lines, round(share, 6) AS share FROM b WHERE lines >= 2 AND share >= 0.6"""
)
def flagged_blocks(s, d):
    ln = inputs.lines(s, d)
    rep = ln.where("text != ''").groupBy("text").agg(F.countDistinct("doc_id").alias("n")).where("n >= 2").select("text")
    marked = ln.where("text <> ''").join(rep.withColumn("f", F.lit(True)), "text", "left").withColumn("flag", F.coalesce("f", F.lit(False)))
    return relations.flagged_blocks(marked, ["doc_id"], "line", "flag").withColumn("share", F.round("share", 6))


@query("SELECT page_id, pos, c[pos] AS comment FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c FROM pages))")
def comment_extract(s, d):
    c = F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))
    return table(s, d, "pages").select("page_id", F.posexplode(c).alias("p", "comment")).select("page_id", (F.col("p") + 1).cast("bigint").alias("pos"), "comment")


@query(f"WITH {LINES_SQL} SELECT doc_id, min(line) AS line FROM lines WHERE line < 5 AND regexp_matches(lower(text), 'license|copyright|spdx') GROUP BY doc_id")
def license_header(s, d):
    return inputs.lines(s, d).where((F.col("line") < 5) & F.lower("text").rlike("license|copyright|spdx")).groupBy("doc_id").agg(F.min("line").alias("line"))


@query("SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '^(?:.*/)?en/[^/]*$') THEN '**/en/*' WHEN regexp_matches(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '^/d[^/]/.*$') THEN '/d?/**' END AS glob FROM pages")
def glob_filter(s, d):
    return table(s, d, "pages").select("page_id", ft.first_glob(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1), ["**/en/*", "/d?/**"]).alias("glob"))


@query(f"WITH {NS_SQL} SELECT page_id, ns, ns = 'net' OR ns LIKE 'net.%' OR ns = 'org.example' OR ns LIKE 'org.example.%' AS excluded FROM ns")
def namespace_exclusion(s, d):
    return inputs.namespaces(s, d).select("page_id", "ns", ft.namespace_covered(F.col("ns"), ["net", "org.example"]).alias("excluded"))


@query("SELECT page_id, regexp_matches(lower(url), '/obj/|\\.g\\.cs$|/es/[0-9]+$') AS skipped FROM pages")
def skip_document(s, d):
    p = F.col("url")
    return table(s, d, "pages").select("page_id", (ft.is_generated(p) | F.lower(p).rlike("/es/[0-9]+$")).alias("skipped"))


@query("SELECT page_id, list_contains(list_slice(string_split(replace(lower(url), '/en/', '/tests/'), '/'), 1, len(string_split(url, '/')) - 1), 'tests') AS is_test FROM pages")
def test_code(s, d):
    return table(s, d, "pages").select("page_id", ft.is_test_code(F.replace(F.lower("url"), F.lit("/en/"), F.lit("/tests/"))).alias("is_test"))


NESTED_SQL = """j AS (SELECT event_type, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type),
leaf AS (SELECT event_type || ':k' AS key, CAST(k AS VARCHAR) AS value FROM j UNION ALL SELECT event_type || ':limits:max', CAST(k + 1 AS VARCHAR) FROM j)"""


def _leaves(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    j = e.groupBy("event_type").agg(F.max(k).alias("k"))
    doc = F.to_json(F.create_map("event_type", F.struct(F.col("k"), F.struct((F.col("k") + 1).alias("max")).alias("limits"))))
    from lodeworks.sources.config_leaves import flatten_json

    return flatten_json(j.select(F.col("event_type").alias("file"), doc.alias("json")), "json").select("key", "value")


@query(f"WITH {NESTED_SQL} SELECT key, value FROM leaf")
def json_flatten(s, d):
    return _leaves(s, d)


@query(f"WITH {NESTED_SQL}, p AS (SELECT unnest(['limits:max', 'click:k', 'absent:k']) AS path) SELECT key FROM leaf WHERE NOT EXISTS (SELECT 1 FROM p WHERE lower(key) = lower(path) OR ends_with(lower(key), ':' || lower(path)))")
def unbound_keys(s, d):
    paths = s.sql("SELECT explode(array('limits:max', 'click:k', 'absent:k')) AS path")
    return relations.suffix_unbound(_leaves(s, d), paths).select("key")


@query(f"WITH {NESTED_SQL}, seg AS (SELECT DISTINCT lower(unnest(string_split(key, ':'))) AS n FROM leaf), p AS (SELECT unnest(['Max', 'Click', 'Timeout', 'Retries']) AS property) SELECT property FROM p WHERE lower(property) NOT IN (SELECT n FROM seg)")
def unset_properties(s, d):
    seg = _leaves(s, d).select(F.explode(F.split(F.lower("key"), ":")).alias("n")).distinct()
    p = s.sql("SELECT explode(array('Max', 'Click', 'Timeout', 'Retries')) AS property")
    return p.join(seg, F.lower("property") == F.col("n"), "left_anti")


# ---------------------------------------------------------------- complexity


@query("SELECT l_orderkey AS body_id, CAST(1 + sum(CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) AS BIGINT) AS complexity FROM lineitem GROUP BY l_orderkey")
def cyclomatic(s, d):
    from lodeworks.operators.complexity import cyclomatic as score

    nodes = table(s, d, "lineitem").select(F.col("l_orderkey").alias("body_id"), F.when(F.col("l_returnflag").isin("R", "A"), "if").otherwise("block").alias("kind"))
    return score(nodes)


@query(
    f"""WITH {NUMBERED_SQL}, x AS (SELECT *, coalesce(sum(CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS deep,
  CASE WHEN l_linestatus = 'F' THEN 'and' ELSE 'or' END AS op FROM li),
o AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY l_orderkey ORDER BY n) IS DISTINCT FROM op THEN 1 ELSE 0 END AS run FROM x WHERE l_tax < 0.04),
y AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 1 + deep WHEN 'A' THEN 1 ELSE 0 END AS c FROM x UNION ALL SELECT l_orderkey, run FROM o)
SELECT l_orderkey AS body_id, CAST(sum(c) AS BIGINT) AS complexity FROM y GROUP BY l_orderkey"""
)
def cognitive(s, d):
    from lodeworks.operators.complexity import cognitive as score

    # a line of the order is a statement inside the one before it; boolean operators are children of the order's first line
    n = numbered(s, d)
    kind = F.when(F.col("l_returnflag") == "R", "if").when(F.col("l_returnflag") == "A", "else").otherwise("block")
    statements = n.select(F.col("l_orderkey").alias("body_id"), F.col("n").cast("long").alias("node_id"), F.when(F.col("n") > 1, F.col("n") - 1).cast("long").alias("parent_id"), F.col("n").alias("ord"), kind.alias("kind"), F.lit(None).cast("string").alias("operator"))
    op = F.when(F.col("l_linestatus") == "F", "and").otherwise("or")
    operators = n.where("l_tax < 0.04").select(F.col("l_orderkey").alias("body_id"), (F.col("n") + 1000).cast("long").alias("node_id"), F.lit(1).cast("long").alias("parent_id"), F.col("n").alias("ord"), op.alias("kind"), op.alias("operator"))
    return score(statements.unionByName(operators))


@query(f"""WITH {NUMBERED_SQL}, c AS (SELECT l_orderkey, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY n) IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS c FROM li)
SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS runs FROM c GROUP BY l_orderkey""")
def operator_runs(s, d):
    from lodeworks.operators.complexity import operator_runs as runs

    nodes = numbered(s, d).select(F.col("l_orderkey").alias("body_id"), F.col("l_orderkey").alias("tree_id"), F.col("n").alias("ord"), F.col("l_returnflag").alias("operator"))
    return runs(nodes).groupBy(F.col("body_id").alias("l_orderkey")).agg(F.count("*").alias("runs"))


# ---------------------------------------------------------------- findings

SPLIT = "2024-01-15"
FP = "sha256(rule_id || '|' || CASE WHEN starts_with(file_path, '/repo/') THEN substr(file_path, 7) ELSE file_path END || '|' || message)"


def _printed(s, d):
    return inputs.findings(s, d).withColumn("fingerprint", findings.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message"), "/repo"))


def _sides(s, d):
    f = _printed(s, d)
    # the stored side also holds the first days of the current one
    return f.where(f"ts >= timestamp '{SPLIT}'"), f.where("ts < timestamp '2024-01-20'")


SIDES_SQL = f"WITH {FINDINGS_SQL}, p AS (SELECT {FP} AS fingerprint, ts FROM f), cur AS (SELECT DISTINCT fingerprint FROM p WHERE ts >= TIMESTAMP '{SPLIT}'), old AS (SELECT DISTINCT fingerprint FROM p WHERE ts < TIMESTAMP '2024-01-20')"


@query(f"WITH {FINDINGS_SQL} SELECT event_id, {FP} AS fingerprint FROM f")
def fingerprint(s, d):
    return _printed(s, d).select("event_id", "fingerprint")


@query(f"{SIDES_SQL} SELECT fingerprint FROM cur EXCEPT SELECT fingerprint FROM old")
def baseline_new(s, d):
    return findings.against_baseline(*_sides(s, d))["new"]


@query(f"{SIDES_SQL} SELECT fingerprint FROM cur INTERSECT SELECT fingerprint FROM old")
def baseline_known(s, d):
    return findings.against_baseline(*_sides(s, d))["known"]


@query(f"{SIDES_SQL} SELECT fingerprint FROM old EXCEPT SELECT fingerprint FROM cur")
def resolved(s, d):
    return findings.against_baseline(*_sides(s, d))["resolved"]


@query(f"{SIDES_SQL} SELECT row_number() OVER (ORDER BY fingerprint) AS pos, fingerprint FROM cur")
def baseline_write(s, d):
    # positions over the sorted partitions: counts of the parts, then places in them
    from lodeworks.operators.order import number_rows

    return number_rows(findings.baseline(_sides(s, d)[0]), ["fingerprint"], "pos")


CONFIG = findings.Config(rules={"CLICK": "off", "view": "high", "signup": "advisory", "nothing": "off"}, paths=("**/u1?/**", "**/e*7.cs", "none/*"), namespaces=("net", "zz.none"))
CLASS_SQL = f"""{FINDINGS_SQL}, c AS (SELECT *, CASE WHEN lower(rule_id) IN ('click', 'nothing') THEN 'disabled'
  WHEN regexp_matches(file_path, '^(?:.*/)?u1[^/]/.*$') OR regexp_matches(file_path, '^(?:.*/)?e[^/]*7\\.cs$') THEN 'path' WHEN lower(rule_id) IN ('view', 'signup') THEN 'override' ELSE 'kept' END AS outcome,
  CASE WHEN regexp_matches(file_path, '^(?:.*/)?u1[^/]/.*$') THEN '**/u1?/**' WHEN regexp_matches(file_path, '^(?:.*/)?e[^/]*7\\.cs$') THEN '**/e*7.cs' END AS g,
  CASE lower(rule_id) WHEN 'view' THEN 2 WHEN 'signup' THEN 4 END AS t FROM f),
k AS (SELECT *, CASE WHEN outcome = 'path' THEN g END AS matched_glob, CASE WHEN outcome = 'override' THEN t ELSE certainty END AS new_certainty FROM c)"""


@query(f"WITH {CLASS_SQL} SELECT event_id, outcome, matched_glob, new_certainty FROM k")
def classify(s, d):
    return findings.classify(inputs.findings(s, d), CONFIG).select("event_id", "outcome", "matched_glob", "new_certainty")


@query(f"WITH {CLASS_SQL} SELECT event_id, new_certainty AS certainty, file_path FROM k WHERE outcome IN ('override', 'kept')")
def apply_filter(s, d):
    return findings.apply(inputs.findings(s, d), CONFIG).select("event_id", "certainty", "file_path")


@query(f"WITH {FINDINGS_SQL} SELECT event_id, certainty FROM f WHERE certainty <= 2")
def tier_floor(s, d):
    return findings.tier_floor(inputs.findings(s, d), "high").select("event_id", "certainty")


@query(f"WITH {FINDINGS_SQL} SELECT row_number() OVER (ORDER BY certainty, file_path, line_number, character_offset, rule_id, message, category, title) AS pos, event_id FROM f")
def report_order(s, d):
    from lodeworks.operators.order import number_rows

    return number_rows(inputs.findings(s, d), findings.ORDER, "pos").select("pos", "event_id")


@query(
    f"""WITH {CLASS_SQL}, hit AS (SELECT rule_id, CASE outcome WHEN 'disabled' THEN 'rule' WHEN 'path' THEN 'path' WHEN 'override' THEN 'override' ELSE CASE WHEN certainty > 3 THEN 'tier' END END AS channel,
  CASE WHEN outcome = 'path' THEN matched_glob WHEN outcome IN ('disabled', 'override') THEN lower(rule_id) ELSE 'moderate' END AS selector FROM k),
sel(channel, selector) AS (VALUES ('rule', 'click'), ('rule', 'nothing'), ('override', 'view'), ('override', 'signup'), ('path', '**/u1?/**'), ('path', '**/e*7.cs'), ('path', 'none/*'), ('tier', 'moderate'))
SELECT sel.channel, sel.selector, count(rule_id) AS findings, coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS rules FROM sel LEFT JOIN hit ON hit.channel = sel.channel AND hit.selector = sel.selector GROUP BY ALL"""
)
def audit_entries(s, d):
    return findings.audit_entries(inputs.findings(s, d), CONFIG, "moderate")


@query(
    f"""WITH {CLASS_SQL}, x AS (SELECT *, outcome IN ('disabled', 'path') OR new_certainty > 3 AS gone FROM k)
SELECT count(*) AS analysed, count(*) FILTER (WHERE gone) AS dropped, count(*) FILTER (WHERE outcome = 'override' AND NOT gone AND new_certainty > certainty) AS downgraded, count(*) FILTER (WHERE NOT gone) AS visible,
CAST(round(100.0 * (count(*) FILTER (WHERE gone) + 7) / (count(*) + 7)) AS BIGINT) AS hidden_debt_percent FROM x"""
)
def audit_totals(s, d):
    return findings.audit_totals(inputs.findings(s, d), CONFIG, "moderate", shadowed=7)


@query(
    f"""WITH {FINDINGS_SQL}, {NS_SQL}, sel(channel, selector) AS (VALUES ('rule', 'click'), ('rule', 'nothing'), ('override', 'view'), ('override', 'signup')),
g(selector, pattern) AS (VALUES ('**/u1?/**', '^(?:.*/)?u1[^/]/.*$'), ('**/e*7.cs', '^(?:.*/)?e[^/]*7\\.cs$'), ('none/*', '^none/[^/]*$')), n(selector) AS (VALUES ('net'), ('zz.none'))
SELECT channel, selector, 'suspected' AS confidence FROM sel WHERE selector NOT IN (SELECT lower(rule_id) FROM f)
UNION ALL SELECT 'path', selector, 'certain' FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE regexp_matches(file_path, pattern))
UNION ALL SELECT 'namespace', selector, 'certain' FROM n WHERE NOT EXISTS (SELECT 1 FROM ns WHERE ns = selector OR starts_with(ns, selector || '.'))"""
)
def obsolete_suppressions(s, d):
    f = inputs.findings(s, d)
    return findings.obsolete(f, CONFIG, f.select(F.col("file_path").alias("path")), inputs.namespaces(s, d).select("ns"))


@query(f"{SIDES_SQL}, dis AS (SELECT DISTINCT {FP} AS fingerprint FROM f WHERE rule_id = 'click') SELECT fingerprint FROM cur EXCEPT (SELECT fingerprint FROM old UNION SELECT fingerprint FROM dis)")
def namespace_shadow(s, d):
    cur, old = _sides(s, d)
    return findings.namespace_shadow(cur, old, _printed(s, d).where("rule_id = 'click'"))


# ---------------------------------------------------------------- entropy

LEDGER_SQL = """led AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at_utc, o_orderkey % 10 AS new_findings, o_orderkey % 4 AS resolved_findings, o_custkey % 700 - 20 AS lines_changed FROM orders)"""


def _ledger(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("commit_sha"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at_utc"), (F.col("o_orderkey") % 10).alias("new_findings"), (F.col("o_orderkey") % 4).alias("resolved_findings"), (F.col("o_custkey") % 700 - 20).alias("lines_changed"))


STATUS_SQL = """st AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AS baseline_existed, CASE WHEN o_orderkey % 7 <> 0 THEN 'h' || (o_custkey % 3) END AS baseline_sha, o_orderkey % 13 <> 0 AS is_git, CASE WHEN o_orderkey % 5 <> 0 THEN 'h' || (o_orderkey % 4) END AS head_sha,
  o_orderkey % 17 = 0 AS dirty, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_custkey % 120 - 5 AS INTEGER) END AS lines FROM orders)"""


@query(
    f"""WITH {STATUS_SQL} SELECT id, CASE WHEN NOT baseline_existed THEN 'baseline_seeded' WHEN baseline_sha IS NULL THEN 'no_baseline_reference' WHEN NOT is_git OR head_sha IS NULL THEN 'not_a_git_repository' WHEN dirty THEN 'dirty_working_tree'
  WHEN lines IS NULL THEN 'not_a_git_repository' WHEN baseline_sha = head_sha THEN 'unchanged_range' WHEN lines < 50 THEN 'below_minimum_change' ELSE 'scored' END AS status FROM st"""
)
def entropy_status(s, d):
    k = F.col("o_orderkey")
    sha = lambda c, n: F.concat(F.lit("h"), (F.col(c) % n).cast("string"))
    df = table(s, d, "orders").select(
        k.alias("id"), (k % 11 != 0).alias("baseline_existed"), F.when(k % 7 != 0, sha("o_custkey", 3)).alias("baseline_sha"), (k % 13 != 0).alias("is_git"), F.when(k % 5 != 0, sha("o_orderkey", 4)).alias("head_sha"),
        (k % 17 == 0).alias("dirty"), F.when(k % 19 != 0, (F.col("o_custkey") % 120 - 5).cast("int")).alias("lines"),
    )
    return df.select("id", entropy.status().alias("status"))


@query(
    f"""WITH {LEDGER_SQL}, x AS (SELECT commit_sha, new_findings, CASE WHEN lines_changed <= 0 OR lines_changed < 50 THEN 'below_minimum_change' ELSE 'scored' END AS status, lines_changed FROM led),
y AS (SELECT commit_sha, status, CASE WHEN lines_changed > 0 THEN new_findings * 1000.0 / lines_changed END AS r FROM x)
SELECT commit_sha, status, round(r, 6) AS rate, coalesce(status = 'scored' AND r > 20.0, false) AS exceeds FROM y"""
)
def entropy_rate(s, d):
    x = _ledger(s, d).withColumns({"baseline_existed": F.lit(True), "baseline_sha": F.lit("b"), "is_git": F.lit(True), "head_sha": F.lit("h"), "dirty": F.lit(False)}).withColumnRenamed("lines_changed", "lines").withColumn("status", entropy.status())
    r = entropy.rate(F.col("new_findings"), F.col("lines"), F.col("status"))
    return x.select("commit_sha", "status", F.round(r, 6).alias("rate"), entropy.exceeds(r, F.col("status"), 20.0).alias("exceeds"))


@query(
    f"""WITH {LEDGER_SQL}, m AS (SELECT substr(recorded_at_utc, 1, 7) AS month, CAST(sum(new_findings) AS BIGINT) AS new_findings, CAST(sum(resolved_findings) AS BIGINT) AS resolved_findings, CAST(sum(greatest(lines_changed, 0)) AS BIGINT) AS lines_changed FROM led GROUP BY 1)
SELECT month, new_findings, resolved_findings, lines_changed, round(CASE WHEN lines_changed > 0 THEN new_findings * 1000.0 / lines_changed END, 6) AS rate FROM m"""
)
def monthly_rates(s, d):
    return entropy.monthly(_ledger(s, d)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {LEDGER_SQL}, new AS (SELECT commit_sha, recorded_at_utc, new_findings + 100 AS new_findings, resolved_findings, lines_changed FROM led WHERE new_findings = 3) SELECT * FROM led WHERE commit_sha NOT IN (SELECT commit_sha FROM new) UNION ALL SELECT * FROM new")
def ledger_upsert(s, d):
    led = _ledger(s, d)
    return entropy.upsert(led, led.where("new_findings = 3").withColumn("new_findings", F.col("new_findings") + 100))


@query("SELECT CAST(sum(l_linenumber + CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem WHERE NOT regexp_matches('src/' || CAST(l_partkey AS VARCHAR) || '.cs', '^src/1[^/]*\\.cs$')")
def changed_lines(s, d):
    rows = table(s, d, "lineitem").select(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".cs")).alias("path"), F.col("l_linenumber").alias("added"), F.col("l_quantity").cast("bigint").alias("deleted"))
    return entropy.changed_lines(rows, ["src/1*.cs"])


# ---------------------------------------------------------------- dedup, versions, reports


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, event_id) AS r FROM events) WHERE r = 1")
def dedupe_preferred(s, d):
    return findings.preferred(table(s, d, "events"), ["user_id"], [F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_per_key(s, d):
    return findings.preferred(table(s, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r > 1")
def duplicate_sibling(s, d):
    w = Window.partitionBy("user_id", "event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r > 1").select("event_id")


@query(
    """WITH v AS (SELECT lower(p_brand) AS id, p_size // 10 AS a, p_size % 10 AS b FROM part), m AS (SELECT id, max(a * 10 + b) AS x FROM v GROUP BY id) SELECT id, CAST(x // 10 AS VARCHAR) || '.' || CAST(x % 10 AS VARCHAR) AS version FROM m"""
)
def max_version(s, d):
    v = table(s, d, "part").select(F.lower("p_brand").alias("id"), F.concat(F.expr("p_size div 10").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string")).alias("version"))
    return v.groupBy("id").agg(F.max_by("version", ft.version_struct(F.col("version"))).alias("version"))


@query(f"WITH {FINDINGS_SQL} SELECT rule_id AS id, min_by(title, event_id) AS name FROM f GROUP BY rule_id")
def sarif_rules(s, d):
    from lodeworks.sinks.reports import sarif_rules as rules

    return rules(inputs.findings(s, d), "event_id")


NAMES_SQL = f"""t AS (SELECT *, CASE certainty WHEN 1 THEN 'Guaranteed' WHEN 2 THEN 'High' WHEN 3 THEN 'Moderate' ELSE 'Advisory' END AS tier, CASE WHEN certainty = 1 THEN 'error' WHEN certainty = 4 THEN 'note' ELSE 'warning' END AS level,
  list_extract([{", ".join(f"'{c}'" for c in CATEGORIES)}], category) AS cat, CASE WHEN row_number() OVER (ORDER BY certainty, file_path, line_number, character_offset, rule_id, message, category, title) > 1 THEN ',' ELSE '' END AS comma FROM f)"""


@query(
    f"""WITH {FINDINGS_SQL}, {NAMES_SQL} SELECT '{{"toolVersion":"1.0","generatedAtUtc":"2024-01-01T00:00:00Z","findings":[' AS json UNION ALL SELECT ']}}'
UNION ALL SELECT comma || '{{"ruleId":"' || rule_id || '","title":"' || title || '","message":"' || message || '","certainty":"' || tier || '","category":"' || cat || '","filePath":"' || file_path || '","lineNumber":' || line_number || ',"characterOffset":' || character_offset || '}}' FROM t"""
)
def report_json(s, d):
    from lodeworks.sinks.reports import json_report

    return json_report(inputs.findings(s, d), tool_version="1.0", commit_sha=None, generated_at_utc="2024-01-01T00:00:00Z")


@query(
    f"""WITH {FINDINGS_SQL}, {NAMES_SQL}, ru AS (SELECT rule_id AS id, min_by(title, (certainty, file_path, line_number, character_offset, rule_id, message, category, title)) AS name FROM f GROUP BY rule_id)
SELECT '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"lodeworks","version":"1.0","rules":[' || string_agg('{{"id":"' || id || '","name":"' || name || '","shortDescription":{{"text":"' || name || '"}}}}', ',' ORDER BY id) || ']}}}},"results":[' AS json FROM ru
UNION ALL SELECT ']}}]}}' UNION ALL SELECT comma || '{{"ruleId":"' || rule_id || '","level":"' || level || '","message":{{"text":"' || message || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"file://' || file_path || '"}},"region":{{"startLine":' || line_number || ',"startColumn":' || character_offset || '}}}}}}],"properties":{{"certainty":"' || tier || '","category":"' || cat || '"}}}}' FROM t"""
)
def sarif_report(s, d):
    from lodeworks.sinks.reports import sarif_report as log

    return log(inputs.findings(s, d), "1.0")


@query("SELECT message, count(*) AS copies FROM (SELECT 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message FROM events) GROUP BY message")
def warning_counts(s, d):
    return inputs.findings(s, d).groupBy("message").agg(F.count("*").alias("copies"))


@query("SELECT doc_id, line, nullif(trim(text), '') AS text FROM (SELECT doc_id, 3 AS line, string_split(text, chr(10))[3] AS text FROM documents)")
def source_line(s, d):
    return table(s, d, "documents").select("doc_id", F.lit(3).alias("line"), F.nullif(F.trim(F.get(F.split("text", "\n"), F.lit(2))), F.lit("")).alias("text"))


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS ns FROM pages")
def namespace_inventory(s, d):
    return table(s, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("ns")).distinct()


CODE = ["try { Go(); }", "var a = b ?? c;", "x?.Close();", "return 1;", "if (n == null)", "throw new E();", "int count = 3;", "if (rows.Count > 0)", "} catch (E)", "// ?? == null", "go(); // n is null", "if (a) go();"]
FIXES = (0, 1, 2, 4, 5, 7, 8)


@query(f"SELECT l_orderkey, l_suppkey % {len(CODE)} AS a, l_partkey % {len(CODE)} AS r, a IN {FIXES} AND a <> r AS fix, count(*) AS times FROM lineitem GROUP BY ALL")
def fix_shape(s, d):
    """Changes of one line: what is added against what is removed."""
    from lodeworks.functions.fix_shape import fix_shaped

    of = lambda c: F.get(F.array(*map(F.lit, CODE)), F.col(c).cast("int"))
    li = table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % len(CODE)).alias("a"), (F.col("l_partkey") % len(CODE)).alias("r"))
    g = li.groupBy("l_orderkey", "a", "r").agg(F.count("*").alias("times"))
    return g.withColumn("fix", fix_shaped(F.array(of("a")), F.array(of("r"))))


def _renames() -> list[tuple[int, int]]:
    """Pairs of CODE with one skeleton: what is left without letters, digits and underscores."""
    bare = ["".join(c for c in x if not c.isalnum() and c != "_") for x in CODE]
    return [(i, j) for i, a in enumerate(bare) for j, b in enumerate(bare) if a == b]


N = len(CODE)


@query(
    f"""WITH m AS (SELECT p_partkey // 4 AS set_id, 'p' || p_partkey AS path, p_size AS a, p_size + 10 AS b FROM part),
co AS (SELECT DISTINCT 'c' || (l_suppkey % 100) AS sha, l_suppkey % 100 AS ord FROM lineitem WHERE l_suppkey % 100 % 13 <> 0),
h AS (SELECT 'c' || (l_suppkey % 100) AS sha, 'p' || l_partkey AS path, l_linenumber * 8 AS ns, l_linenumber % 2 AS oc, l_orderkey % {N} AS ad, l_partkey % {N} AS rm, l_tax >= 0.08 AS made FROM lineitem WHERE l_quantity <= 3),
cf AS (SELECT DISTINCT sha, path FROM h), last AS (SELECT path, min_by(sha, ord) AS sha, min(ord) AS ord FROM cf JOIN co USING (sha) WHERE path IN (SELECT path FROM m) GROUP BY path),
ml AS (SELECT m.*, sha, ord FROM m JOIN last USING (path)), pr AS (SELECT ml.set_id, ml.path, ml.sha, ml.ord, s.path AS sp, s.a AS sa, s.b AS sb FROM ml JOIN m s ON s.set_id = ml.set_id AND s.path <> ml.path),
sided AS (SELECT set_id, path, string_agg(DISTINCT sp, ',' ORDER BY sp) AS siblings FROM pr GROUP BY set_id, path, sha HAVING bool_and((sha, sp) NOT IN (SELECT (sha, path) FROM cf))),
later AS (SELECT pr.set_id, pr.path, string_agg(DISTINCT sp, ',' ORDER BY sp) AS catch_ups FROM pr JOIN last l ON l.path = sp AND l.ord < pr.ord GROUP BY pr.set_id, pr.path),
earlier AS (SELECT DISTINCT pr.set_id, pr.path FROM pr JOIN last l ON l.path = sp AND l.ord > pr.ord JOIN h ON h.sha = l.sha AND h.path = sp AND oc > 0 AND ns >= sa - 1 AND ns <= sb + 1),
ch AS (SELECT ml.set_id, ml.path, ml.sha, ns, siblings, coalesce(catch_ups, '') AS catch_ups, ad IN {FIXES} AND ad <> rm AND (ad, rm) NOT IN ({", ".join(f"({i}, {j})" for i, j in _renames())}) AS fix
  FROM ml JOIN sided USING (set_id, path) LEFT JOIN later USING (set_id, path) JOIN h ON h.sha = ml.sha AND h.path = ml.path WHERE NOT made AND ns >= a - 1 AND ns <= b + 1 AND (set_id, ml.path) NOT IN (SELECT (set_id, path) FROM earlier)),
o AS (SELECT *, CASE WHEN fix THEN 'high' ELSE 'advisory' END AS tier FROM ch)
SELECT set_id, path, sha, CAST(ns AS INTEGER) AS anchor, tier, siblings, catch_ups FROM (SELECT *, row_number() OVER (PARTITION BY sha, path ORDER BY tier DESC, set_id, ns) AS r FROM o) WHERE r = 1"""
)
def clone_drift(s, d):
    """One-sided changes of clone sets, whole: last commits, siblings, earlier fixes, catch-ups, the shape of the change."""
    from lodeworks.operators import drift
    from lodeworks.plans.rule_queries import facts

    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    k, n = F.col("p_partkey"), F.col("l_suppkey") % 100
    members = table(s, d, "part").select(F.expr("p_partkey div 4").alias("set_id"), name("p", k).alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"))
    li = table(s, d, "lineitem")
    commits = li.select(name("c", n).alias("sha"), n.alias("log_pos"), (n % 13 == 0).alias("is_merge")).distinct()
    of = lambda c: F.array(F.get(F.array(*map(F.lit, CODE)), (F.col(c) % N).cast("int")))
    start = (F.col("l_linenumber") * 8).cast("int")
    hunks = li.where("l_quantity <= 3").select(
        name("c", n).alias("sha"), name("p", F.col("l_partkey")).alias("path"), start.alias("new_start"), F.lit(1).alias("new_count"), (F.col("l_linenumber") % 2).alias("old_count"), of("l_orderkey").alias("added"), of("l_partkey").alias("removed"),
        F.array(start).alias("changed_new_lines"), (F.col("l_tax") >= 0.08).alias("is_file_creation"),
    )
    f = facts(s, commits=commits, hunks=hunks, commit_files=hunks.select("sha", "path").distinct())
    found = drift.detect(members, f["commits"], f["commit_files"], f["hunks"], f["identifiers"], f["exec_lines"])
    return found.withColumns({"siblings": F.array_join("siblings", ","), "catch_ups": F.array_join("catch_ups", ",")})
