"""The rules as queries: each over analogue facts read off the supplied tables, with its SQL.

A part stands for a declaration, a line item of small quantity for a reference to it, an order for a body, a project or a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.rules import code, packages, shapes
from lodeworks.sources.facts import SCHEMAS, Facts
from lodeworks.sources.tables import table

#: Declarations (k tells their kind, their accessibility and the rest) and references.
DECL_SQL = """d AS (SELECT p_partkey AS k, 'p' || p_partkey AS symbol_id, p_name AS name, 'src/' || p_brand || '.cs' AS path, p_size AS line FROM part),
r AS (SELECT 'p' || l_partkey AS symbol_id, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, l_partkey AS k FROM lineitem WHERE l_quantity <= 2)"""
FOUND = "path AS file_path, line AS line_number, CAST({tier} AS INTEGER) AS certainty, symbol_id, {text} AS message"


def found(tier, text: str) -> str:
    return FOUND.format(tier=tier, text=text)


def facts(spark: SparkSession, **tables: DataFrame) -> Facts:
    """Facts of the given tables; columns that one lacks are null."""
    full = {}
    for name, df in tables.items():
        full[name] = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMAS[name])))
    return Facts(spark, tables=full)


def declared(s: SparkSession, d: str, **more: Column) -> DataFrame:
    base = {"accessibility": F.lit("private"), "is_static": F.lit(False), "is_virtual": F.lit(False), "is_override": F.lit(False), "is_abstract": F.lit(False), "is_sealed": F.lit(False), "has_friends": F.lit(False), "attributes": none()}
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), name_of("p", "p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit(".cs")).alias("path"), F.col("p_size").alias("line"), F.lit(0).alias("ch"))
    return p.withColumns(base | more)


def referenced(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").where("l_quantity <= 2")
    return li.select(name_of("p", "l_partkey").alias("symbol_id"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))


def name_of(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def none() -> Column:
    return F.expr("cast(array() as array<string>)")


def k_is(n: int, rest: int = 0) -> Column:
    return F.col("k") % n == rest


def kinds(*names: str) -> Column:
    """By the remainder of k."""
    return F.get(F.array(*map(F.lit, names)), (F.col("k") % len(names)).cast("int"))


def rows(found: DataFrame) -> DataFrame:
    return found.select("file_path", "line_number", F.col("certainty").cast("int").alias("certainty"), "symbol_id", "message")


QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda s, d: rows(f(s, d))
        ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- declarations and references


@query(f"""WITH {DECL_SQL} SELECT {found(1, "'Private ' || CASE k % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'field' ELSE 'property' END || ' ''' || name || ''''")} FROM d
WHERE k % 3 <> 0 AND k % 4 <> 3 AND k % 7 <> 0 AND k % 11 <> 0 AND symbol_id NOT IN (SELECT symbol_id FROM r)""")
def rule_unused_private(s, d):
    marks = F.when(k_is(7), F.array(F.lit("DataMember"))).when(k_is(11), F.array(F.lit("FactAttribute"))).otherwise(none())
    decl = declared(s, d, kind=kinds("method", "field", "property", "event"), accessibility=F.when(k_is(3), "public").otherwise("private"), attributes=marks)
    return code.unused_private(facts(s, declarations=decl, references=referenced(s, d)))


NUMBERED_SQL = "li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS INTEGER) AS n FROM lineitem)"


def numbered(s, d):
    """Line items with their place in the order, n."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return table(s, d, "lineitem").withColumn("n", F.row_number().over(w))


@query(f"""WITH {NUMBERED_SQL}, dead AS (SELECT l_orderkey, n, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR l_discount >= 0.1 AS x
  FROM li WHERE l_tax >= 0.02)
SELECT 'o' || l_orderkey AS file_path, min(n) AS line_number, 1 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Statement can never run' AS message FROM dead WHERE x GROUP BY l_orderkey""")
def rule_unreachable(s, d):
    li = numbered(s, d)
    st = li.select(name_of("o", "l_orderkey").alias("block_id"), name_of("o", "l_orderkey").alias("path"), F.col("n").alias("ord"), F.col("n").alias("line"), F.lit(0).alias("ch"), (F.col("l_returnflag") == "R").alias("exits"), (F.col("l_discount") < 0.1).alias("start_reachable"), F.when(F.col("l_tax") < 0.02, "empty").otherwise("expression").alias("kind"))
    return code.unreachable(facts(s, statements=st))


NON_PRIVATE_SQL = f"""WITH {DECL_SQL}, x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'method' WHEN 2 THEN 'property' ELSE 'field' END AS kind,
  CASE k % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'internal' ELSE 'public' END AS acc, CASE (k - k % 4) % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'internal' ELSE 'public' END AS around, k % 5 = 0 AS friends FROM d),
live AS (SELECT symbol_id FROM r UNION SELECT 'p' || p_partkey FROM part WHERE p_partkey % 6 = 0 AND 's' || (p_partkey % 50) IN (SELECT 's' || l_suppkey FROM lineitem WHERE l_quantity = 50)),
open AS (SELECT * FROM x WHERE kind <> 'field' AND k % 13 <> 0 AND symbol_id NOT IN (SELECT symbol_id FROM live))"""


def _non_private(s, d):
    of = F.when(k_is(4), F.lit(None)).otherwise(F.concat(F.lit("p"), (F.col("k") - F.col("k") % 4).cast("string")))
    decl = declared(s, d, kind=kinds("type", "method", "property", "field"), accessibility=kinds("private", "internal", "public"), type_id=of, has_friends=k_is(5), is_override=k_is(13))
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    impl = part.where(k_is(6)).select(name_of("p", "k").alias("symbol_id"), F.concat(F.lit("s"), (F.col("k") % 50).cast("string")).alias("contract_symbol_id"))
    calls = table(s, d, "lineitem").where("l_quantity = 50").select(name_of("s", "l_suppkey").alias("symbol_id"))
    seeds = part.where(k_is(20)).select(F.lit("x").alias("type_id"), name_of("p", "k").alias("used_type_id"), F.lit("serialized").alias("via"))
    next_ = part.where(k_is(40)).select(name_of("p", "k").alias("type_id"), F.concat(F.lit("p"), (F.col("k") + 4).cast("string")).alias("used_type_id"), F.lit("property").alias("via"))
    made = part.where(k_is(16)).select(F.lit("x").alias("type_id"), name_of("p", "k").alias("used_type_id"), F.lit("di").alias("via"))
    refs = referenced(s, d).select("symbol_id").unionByName(calls)
    return facts(s, declarations=decl, references=refs, implements=impl, type_edges=seeds.union(next_).union(made))


@query(f"""{NON_PRIVATE_SQL} SELECT {found("CASE WHEN friends OR (kind <> 'type' AND (k - k % 4) % 16 = 0) THEN 4 ELSE 3 END", "'Internal ' || kind || ' ''' || name || ''''")} FROM open WHERE acc = 'internal'""")
def rule_unused_internal(s, d):
    return code.unused_internal(_non_private(s, d))


@query(f"""{NON_PRIVATE_SQL}, t AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 20 = 0 UNION SELECT p_partkey + 4 FROM part WHERE p_partkey % 40 = 0)
SELECT {found("CASE WHEN friends OR kind = 'type' OR around = 'public' OR (k - k % 4) % 16 = 0 THEN 4 ELSE 3 END", "'Public ' || kind || ' ''' || name || ''''")} FROM open WHERE acc = 'public' AND k - k % 4 NOT IN (SELECT k FROM t)""")
def rule_unused_public(s, d):
    return code.unused_public(_non_private(s, d))


@query(f"""WITH {DECL_SQL} SELECT {found(1, "'Local ''' || name || ''''")} FROM d WHERE k % 9 <> 0 AND symbol_id NOT IN (SELECT symbol_id FROM r WHERE f = 'R')""")
def rule_unused_local(s, d):
    decl = declared(s, d, kind=F.lit("local"))
    decl = decl.withColumn("name", F.when(k_is(9), "_").otherwise(F.col("name")))
    refs = referenced(s, d).withColumn("kind", F.when(F.col("f") == "R", "read").otherwise("write"))
    return code.unused_local(facts(s, declarations=decl, references=refs))


@query(f"""WITH {DECL_SQL}, own AS (SELECT d.* FROM d WHERE k % 4 = 1 AND k % 3 = 0 AND symbol_id IN (SELECT symbol_id FROM r GROUP BY symbol_id HAVING bool_and(s = 'F')))
SELECT path AS file_path, line AS line_number, 3 AS certainty, 'q' || k AS symbol_id, 'Parameter ''' || name || '''' AS message FROM own WHERE k NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def rule_unused_parameter(s, d):
    methods = declared(s, d, kind=kinds("type", "method", "property", "field"), accessibility=F.when(k_is(3), "private").otherwise("public"))
    given = declared(s, d, kind=F.lit("parameter"), type_id=F.col("symbol_id")).withColumn("symbol_id", name_of("q", "k"))
    calls = referenced(s, d).select("symbol_id", (F.col("s") == "F").alias("is_direct_invocation"))
    uses = table(s, d, "lineitem").where("l_quantity = 50").select(name_of("q", "l_partkey").alias("symbol_id"), F.lit(False).alias("is_direct_invocation"))
    return code.unused_parameter(facts(s, declarations=methods.unionByName(given, allowMissingColumns=True), references=calls.unionByName(uses)))


@query(f"""WITH {DECL_SQL} SELECT {found("CASE WHEN k % 4 = 3 THEN 4 WHEN k % 10 = 0 OR k % 3 <> 2 THEN 2 ELSE 3 END", "'Obsolete ''' || name || ''''")} FROM d
WHERE k % 5 = 0 AND k % 13 <> 0 AND k % 6 <> 0 AND symbol_id NOT IN (SELECT symbol_id FROM r)""")
def rule_obsolete_member(s, d):
    marks = F.when(k_is(10), F.array(F.lit("ObsoleteError"))).when(k_is(5), F.array(F.lit("Obsolete"))).otherwise(none())
    decl = declared(s, d, kind=kinds("type", "method", "property", "enum_member"), accessibility=kinds("private", "internal", "public"), attributes=marks, is_override=k_is(13))
    impl = table(s, d, "part").select(F.col("p_partkey").alias("k")).where(k_is(6)).select(name_of("p", "k").alias("symbol_id"), F.lit("c").alias("contract_symbol_id"))
    return code.obsolete_member(facts(s, declarations=decl, references=referenced(s, d), implements=impl))


@query(f"""WITH {NUMBERED_SQL}, u AS (SELECT 'o' || l_orderkey AS path, n AS pos, 'N' || (l_suppkey % 5) AS name, CASE WHEN l_returnflag = 'R' THEN 'CS8019' WHEN l_returnflag = 'A' THEN 'CS8933' END AS diag FROM li),
a AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY pos) > 1 AS again FROM u)
SELECT path AS file_path, pos AS line_number, 1 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, CASE WHEN again THEN 'Repeated using ''' WHEN diag = 'CS8933' THEN 'Using appears as a global one ''' ELSE 'Unnecessary using ''' END || name || '''' AS message FROM a WHERE diag IS NOT NULL""")
def rule_unused_using(s, d):
    u = numbered(s, d).select(name_of("o", "l_orderkey").alias("path"), F.col("n").alias("pos"), F.col("n").alias("line"), F.concat(F.lit("N"), (F.col("l_suppkey") % 5).cast("string")).alias("name"), F.lit(False).alias("is_global"), F.lit(False).alias("is_static"), F.when(F.col("l_returnflag") == "R", "CS8019").when(F.col("l_returnflag") == "A", "CS8933").alias("diagnostic"))
    return code.unused_using(facts(s, usings=u))


@query(f"""WITH {DECL_SQL}, w AS (SELECT symbol_id FROM r WHERE f <> 'N' GROUP BY symbol_id HAVING bool_or(f = 'A') AND NOT bool_or(f = 'R'))
SELECT {found(2, "'Never read field ''' || name || ''''")} FROM d WHERE k % 2 = 0 AND k % 7 <> 0 AND k % 11 <> 0 AND symbol_id IN (SELECT symbol_id FROM w)""")
def rule_write_only(s, d):
    marks = F.when(k_is(7), F.array(F.lit("JsonInclude"))).when(k_is(11), F.array(F.lit("const"))).otherwise(none())
    decl = declared(s, d, kind=F.when(k_is(2), "field").otherwise("property"), attributes=marks)
    refs = referenced(s, d).withColumn("kind", F.when(F.col("f") == "R", "read").when(F.col("f") == "A", "write").otherwise("nameof"))
    return code.write_only(facts(s, declarations=decl, references=refs))


@query(f"""WITH {DECL_SQL}, v AS (SELECT * FROM d WHERE k % 4 = 1 AND k % 3 <> 0), t AS (SELECT * FROM d WHERE k % 4 = 0 AND k % 7 <> 0 AND k % 12 <> 0 AND k + 1 IN (SELECT k FROM v) AND symbol_id IN (SELECT symbol_id FROM r))
SELECT {found(3, "'Class with virtual members is never inherited ''' || name || ''''")} FROM t
UNION ALL SELECT {found(4, "'Virtual member is never overridden ''' || name || ''''")} FROM v WHERE k - 1 NOT IN (SELECT k FROM t) AND k % 5 <> 0 AND symbol_id IN (SELECT symbol_id FROM r)""")
def rule_never_overridden(s, d):
    is_type, is_method = k_is(4), k_is(4, 1)
    decl = declared(s, d, kind=kinds("type", "method", "property", "field"), accessibility=kinds("private", "internal", "public"), is_virtual=is_method & ~k_is(3), is_sealed=is_type & k_is(7), type_id=F.when(is_method, F.concat(F.lit("p"), (F.col("k") - 1).cast("string"))))
    part = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    inherits = part.where(k_is(12)).select(F.lit("z").alias("derived_id"), name_of("p", "k").alias("base_id"))
    overrides = part.where(k_is(5)).select(F.lit("z").alias("symbol_id"), name_of("p", "k").alias("base_symbol_id"))
    return code.never_overridden(facts(s, declarations=decl, references=referenced(s, d), inherits=inherits, overrides=overrides))


@query(f"""WITH {DECL_SQL}, t AS (SELECT k, line AS lo, line + 20 AS hi FROM d WHERE k % 4 = 0),
ref AS (SELECT symbol_id, CASE WHEN s = 'F' THEN 'one.cs' ELSE 'two.cs' END AS at, n * 8 AS l, f FROM r),
x AS (SELECT d.symbol_id, max(ref.at <> 'one.cs' OR NOT ref.l BETWEEN lo AND hi) AS outside FROM d JOIN t ON t.k = d.k - 2 JOIN ref USING (symbol_id) WHERE d.k % 4 = 2 AND d.k % 3 = 1 GROUP BY d.symbol_id),
f AS (SELECT 1 AS o, k, symbol_id, name, line, 'Can be static: ''' AS what FROM d WHERE k % 4 = 1 AND k % 3 <> 0 AND k % 5 <> 0
UNION ALL SELECT 2, k, symbol_id, name, line, 'Can be readonly: ''' FROM d WHERE k % 4 = 3 AND k % 3 = 0 AND k % 5 <> 0 AND symbol_id IN (SELECT symbol_id FROM ref WHERE f = 'A') AND symbol_id NOT IN (SELECT symbol_id FROM ref WHERE f = 'N')
UNION ALL SELECT 3, k, symbol_id, name, line, 'Can be sealed: ''' FROM d WHERE k % 4 = 0 AND k % 3 <> 2 AND k % 7 <> 0 AND k % 12 <> 0
UNION ALL SELECT 4, k, symbol_id, name, line, 'Can be private: ''' FROM d WHERE symbol_id IN (SELECT symbol_id FROM x WHERE NOT outside))
SELECT 'one.cs' AS file_path, line AS line_number, 4 AS certainty, symbol_id, what || name || '''' AS message FROM f""")
def rule_tighten(s, d):
    of = F.when(k_is(4, 2), F.concat(F.lit("p"), (F.col("k") - 2).cast("string")))
    decl = declared(s, d, kind=kinds("type", "method", "property", "field"), accessibility=kinds("private", "internal", "public"), uses_instance=k_is(3), attributes=F.when(k_is(5), F.array(F.lit("readonly"))).otherwise(none()), is_sealed=k_is(7), type_id=of, span_end=F.col("line") + 20)
    decl = decl.withColumn("path", F.lit("one.cs"))
    refs = referenced(s, d).select("symbol_id", F.when(F.col("s") == "F", "one.cs").otherwise("two.cs").alias("path"), (F.col("n") * 8).alias("line"), F.when(F.col("f") == "R", "read").when(F.col("f") == "A", "write").otherwise("readwrite").alias("kind"))
    inherits = table(s, d, "part").select(F.col("p_partkey").alias("k")).where(k_is(12)).select(F.lit("z").alias("derived_id"), name_of("p", "k").alias("base_id"))
    return code.tighten(facts(s, declarations=decl, references=refs, inherits=inherits))


@query(f"""WITH {DECL_SQL}, m AS (SELECT d.*, k - k % 4 AS fam FROM d WHERE k % 4 < 3 AND (k % 4 > 0 OR k + 1 IN (SELECT k FROM d))),
ref AS (SELECT r.k - r.k % 4 AS fam, r.n <= 5 AS inside FROM r WHERE r.k % 4 < 3),
c AS (SELECT fam FROM ref GROUP BY fam HAVING bool_and(inside)), a AS (SELECT fam FROM m GROUP BY fam HAVING count(*) >= 2 AND NOT bool_or(k % 17 = 0))
SELECT 'one.cs' AS file_path, CAST(k * 10 AS INTEGER) AS line_number, CASE WHEN k % 5 = 0 OR k % 3 = 2 THEN 4 ELSE 3 END AS certainty, symbol_id, 'Overrides call only each other: ''' || name || '''' AS message
FROM m WHERE k = fam AND fam IN (SELECT fam FROM c) AND fam IN (SELECT fam FROM a) AND name NOT IN (SELECT name FROM d WHERE k % 40 = 1)""")
def rule_closed_family(s, d):
    decl = declared(s, d, kind=F.lit("method"), accessibility=kinds("private", "internal", "public"), has_friends=k_is(5), is_abstract=k_is(17)).withColumns({"path": F.lit("one.cs"), "line": (F.col("k") * 10).cast("int"), "span_end": (F.col("k") * 10 + 5).cast("int")})
    overrides = decl.where((F.col("k") % 4).isin(1, 2)).select("symbol_id", F.concat(F.lit("p"), (F.col("k") - F.col("k") % 4).cast("string")).alias("base_symbol_id"))
    refs = referenced(s, d).where("k % 4 < 3").select("symbol_id", F.lit("one.cs").alias("path"), (F.col("k") * 10 + F.col("n")).cast("int").alias("line"))
    literals = decl.where(k_is(40, 1)).select(F.col("name").alias("text"))
    return code.closed_family(facts(s, declarations=decl, overrides=overrides, references=refs, string_literals=literals))


@query(f"""WITH {DECL_SQL} SELECT {found(4, "'Event ''' || name || ''''")} FROM d WHERE k % 2 = 0 AND k % 7 <> 0 AND k % 6 <> 0 AND symbol_id NOT IN (SELECT symbol_id FROM r WHERE f <> 'A')""")
def rule_event_never_raised(s, d):
    decl = declared(s, d, kind=F.when(k_is(2), "event").otherwise("field"), is_abstract=k_is(7))
    impl = table(s, d, "part").select(F.col("p_partkey").alias("k")).where(k_is(6)).select(name_of("p", "k").alias("symbol_id"), F.lit("c").alias("contract_symbol_id"))
    refs = referenced(s, d).select("symbol_id", (F.col("f") == "A").alias("is_subscription"))
    return code.event_never_raised(facts(s, declarations=decl, references=refs, implements=impl))


# ---------------------------------------------------------------- projects, packages, settings

PACKAGE_SQL = """pr AS (SELECT DISTINCT 'o' || l_orderkey AS path, 'S' || l_suppkey AS id, l_suppkey AS k FROM lineitem WHERE l_linenumber <= 2),
ln AS (SELECT path, id, k, CAST(k % 90 + 1 AS INTEGER) AS line FROM pr)"""


def _packages(s, d):
    li = table(s, d, "lineitem")
    refs = li.where("l_linenumber <= 2").select(name_of("o", "l_orderkey").alias("path"), name_of("S", "l_suppkey").alias("id"), F.col("l_suppkey").alias("k")).distinct().withColumn("line", (F.col("k") % 90 + 1).cast("int"))
    return li, refs


@query(f"""WITH {PACKAGE_SQL} SELECT path AS file_path, line AS line_number, CASE WHEN path IN (SELECT 'o' || (o_orderkey // 2) FROM orders WHERE o_orderkey % 14 = 0 AND o_orderkey > 1) AND k % 4 <> 0 THEN 3 ELSE 2 END AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Package ''' || id || ''' is not used' AS message FROM ln
WHERE k % 7 <> 0 AND k % 9 <> 0 AND (path, k % 50) NOT IN (SELECT ('o' || l_orderkey, l_suppkey % 50) FROM lineitem WHERE l_returnflag = 'R')
AND (k % 4 = 0 OR (path, k % 50) NOT IN (SELECT ('o' || (l_orderkey // 2), l_suppkey % 50) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey > 1))""")
def rule_unused_package(s, d):
    li, refs = _packages(s, d)
    refs = refs.withColumns({"compile_excluded": k_is(7), "private_all": k_is(4), "min_version": F.lit("1.0")})
    brings = refs.where(~k_is(9)).select("path", "id", F.concat(F.lit("A"), (F.col("k") % 50).cast("string")).alias("assembly"))
    used = li.where("l_returnflag = 'R'").select(name_of("o", "l_orderkey").alias("path"), F.concat(F.lit("A"), (F.col("l_suppkey") % 50).cast("string")).alias("assembly"))
    o = table(s, d, "orders").where("o_orderkey > 1").select("o_orderkey", name_of("o", "o_orderkey").alias("path"))
    # each project is used by the two of twice its number, which pass nothing on
    flows = o.select("path", F.concat(F.lit("o"), F.expr("o_orderkey div 2").cast("string")).alias("ref_path"), F.lit(True).alias("private_all"))
    projects = o.select("path", F.col("path").alias("assembly_name"), (F.col("o_orderkey") % 14 != 0).alias("is_loaded"))
    return packages.unused_package(facts(s, package_refs=refs, package_assemblies=brings, used_assemblies=used, project_refs=flows, projects=projects))


@query(f"""WITH {PACKAGE_SQL} SELECT path AS file_path, line AS line_number, 2 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Project reference ''' || id || ''' is not used' AS message FROM ln
WHERE k % 7 <> 0 AND k % 9 <> 0 AND (path, id) NOT IN (SELECT ('o' || l_orderkey, 'S' || l_suppkey) FROM lineitem WHERE l_returnflag = 'R')""")
def rule_unused_project(s, d):
    li, refs = _packages(s, d)
    flows = refs.select("path", F.col("id").alias("ref_path"), F.lit(False).alias("private_all"), k_is(7).alias("output_disabled"), k_is(9).alias("is_analyzer"), "line")
    projects = refs.select(F.col("id").alias("path"), F.col("id").alias("assembly_name"), F.lit(True).alias("is_loaded")).distinct()
    used = li.where("l_returnflag = 'R'").select(name_of("o", "l_orderkey").alias("path"), name_of("S", "l_suppkey").alias("assembly"))
    return packages.unused_project(facts(s, project_refs=flows, projects=projects, used_assemblies=used))


@query("""WITH p AS (SELECT 'c' || c_custkey AS path, 'Lib.' || c_name AS assembly_name, c_custkey AS k FROM customer), inn AS (SELECT DISTINCT 'c' || o_custkey AS path FROM orders WHERE o_orderpriority LIKE '1%')
SELECT path AS file_path, 1 AS line_number, 3 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, CASE WHEN k % 3 = 0 THEN 'Project outside the solution: ''' ELSE 'Nothing references project ''' END || assembly_name || '''' AS message
FROM p WHERE path NOT IN (SELECT path FROM inn) AND k % 5 <> 0 AND k % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.k % 11 = 0 AND contains('use:Lib.' || substr(q.assembly_name, 5) || 'x', p.assembly_name))""")
def rule_orphan(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"), name_of("c", "c_custkey").alias("path"), F.concat(F.lit("Lib."), "c_name").alias("assembly_name"))
    projects = c.select("path", "assembly_name", F.when(k_is(5), "Exe").otherwise("Library").alias("output_type"), k_is(7).alias("is_test"), (~k_is(3)).alias("is_loaded"))
    inbound = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.lit("z").alias("path"), name_of("c", "o_custkey").alias("ref_path"))
    texts = c.where(k_is(11)).select(F.concat(F.lit("t"), "path").alias("path"), F.concat(F.lit("use:"), "assembly_name", F.lit("x")).alias("text"))
    return packages.orphan(facts(s, projects=projects, project_refs=inbound, spelled_names=texts))


@query("""WITH o AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS path FROM orders), n AS (SELECT k, path, CAST(k % 7 AS INTEGER) AS mine, CAST(k % 5 AS INTEGER) AS asked FROM o WHERE k % 3 <> 0)
SELECT path AS file_path, 1 AS line_number, 3 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Package ''Base'' comes with another package' AS message FROM n WHERE asked >= mine""")
def rule_redundant_package(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), name_of("o", "o_orderkey").alias("path"))
    version = lambda n: F.concat(F.lit("1."), (F.col("k") % n).cast("string"), F.lit(".0"))
    refs = o.select("path", F.lit("Base").alias("id"), version(7).alias("min_version"), F.lit(1).alias("line")).unionByName(o.where(~k_is(3)).select("path", F.lit("Top").alias("id"), F.lit("2.0").alias("min_version"), F.lit(2).alias("line")))
    locked = o.select("path", F.explode(F.array(F.lit("t8"), F.lit("t9"))).alias("tfm"), F.lit("Base").alias("id"), version(7).alias("version"))
    locked = locked.unionByName(o.where(~k_is(3)).select("path", F.explode(F.array(F.lit("t8"), F.lit("t9"))).alias("tfm"), F.lit("Top").alias("id"), F.lit("2.0").alias("version")))
    deps = o.where(~k_is(3)).select("path", F.explode(F.array(F.lit("t8"), F.lit("t9"))).alias("tfm"), F.lit("Top").alias("id"), F.lit("base").alias("dep_id"), version(5).alias("min_version"))
    return packages.redundant_package(facts(s, package_refs=refs, lock_packages=locked, lock_deps=deps))


@query("""WITH o AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS path FROM orders)
SELECT path AS file_path, 1 AS line_number, 2 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Package ''Json'' is part of the framework' AS message FROM o WHERE k % 9 <= 4 AND (k % 2 = 0 OR k % 9 <= 2) AND k % 11 <> 0""")
def rule_inbox_package(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), name_of("o", "o_orderkey").alias("path"))
    tfms = F.when(k_is(11), F.array(F.lit("t8"), F.lit("t7"))).when(k_is(2), F.array(F.lit("t8"))).otherwise(F.array(F.lit("t8"), F.lit("t9")))
    projects = o.select("path", tfms.alias("tfms"), none().alias("framework_refs"))
    refs = o.select("path", F.lit("Json").alias("id"), F.concat(F.lit("8.0."), (F.col("k") % 9).cast("string")).alias("min_version"), F.lit(1).alias("line"))
    inbox = s.sql("SELECT * FROM VALUES ('t8', false, 'json', '8.0.4'), ('t9', false, 'json', '8.0.2') AS t(tfm, aspnet, id, version)")
    return packages.inbox_package(facts(s, projects=projects, package_refs=refs, inbox_packages=inbox))


SETTINGS_SQL = """leaf AS (SELECT 'f' || n_nationkey AS file, CASE n_nationkey % 4 WHEN 0 THEN 'nlog:' WHEN 1 THEN 'App:' ELSE '' END || n_name || ':Key' || n_regionkey AS key, n_nationkey AS line, n_regionkey AS k FROM nation)"""


def _settings(s, d):
    first = F.get(F.array(F.lit("nlog:"), F.lit("App:"), F.lit(""), F.lit("")), (F.col("n_nationkey") % 4).cast("int"))
    leaves = table(s, d, "nation").select(name_of("f", "n_nationkey").alias("file"), F.concat(first, "n_name", F.lit(":Key"), F.col("n_regionkey").cast("string")).alias("key"), F.col("n_nationkey").alias("line"))
    n = table(s, d, "nation").where("n_nationkey % 3 = 0")
    options = n.select(name_of("t", "n_nationkey").alias("type_id"), F.upper("n_name").alias("path"), F.concat(F.lit("KEY"), F.col("n_regionkey").cast("string")).alias("property"))
    more = table(s, d, "region").select(name_of("u", "r_regionkey").alias("type_id"), F.lit("").alias("path"), F.concat(F.lit("Key"), (F.col("r_regionkey") * 2).cast("string")).alias("property"))
    return facts(s, config_leaves=leaves, option_leaves=options.union(more))


@query(f"""WITH {SETTINGS_SQL}, opt AS (SELECT upper(n_name) || ':KEY' || n_regionkey AS p FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'Key' || (r_regionkey * 2) FROM region)
SELECT file AS file_path, line AS line_number, 4 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Key ''' || key || ''' is bound to no option' AS message FROM leaf
WHERE NOT starts_with(key, 'nlog:') AND NOT EXISTS (SELECT 1 FROM opt WHERE lower(key) = lower(p) OR ends_with(lower(key), ':' || lower(p)))""")
def rule_unbound_key(s, d):
    return packages.unbound_key(_settings(s, d))


@query(f"""WITH {SETTINGS_SQL}, opt AS (SELECT 't' || n_nationkey AS t, 'KEY' || n_regionkey AS p FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'u' || r_regionkey, 'Key' || (r_regionkey * 2) FROM region)
SELECT t AS file_path, 1 AS line_number, 4 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Option ''' || p || ''' is never configured' AS message FROM opt WHERE lower(p) NOT IN (SELECT lower(list_last(string_split(key, ':'))) FROM leaf)""")
def rule_unset_option(s, d):
    return packages.unset_option(_settings(s, d))


# ---------------------------------------------------------------- shapes


@query(f"""WITH {NUMBERED_SQL}, c AS (SELECT 'o' || l_orderkey AS path, n, l_returnflag <> 'N' AS code FROM li WHERE l_discount < 0.09), i AS (SELECT *, n - row_number() OVER (PARTITION BY path ORDER BY n) AS g FROM c)
SELECT path AS file_path, min(n) AS line_number, 4 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Commented-out code over ' || count(*) || ' lines' AS message FROM i GROUP BY path, g HAVING count(*) >= 2 AND avg(CASE WHEN code THEN 1.0 ELSE 0 END) >= 0.6""")
def rule_commented_code(s, d):
    text = F.when(F.col("l_returnflag") == "R", "// x = y;").when(F.col("l_returnflag") == "A", "// return x").otherwise("// plain words")
    c = numbered(s, d).where("l_discount < 0.09").select(name_of("o", "l_orderkey").alias("path"), F.col("n").alias("line"), F.lit(0).alias("ch"), F.lit("line").alias("kind"), text.alias("text"))
    return shapes.commented_code(facts(s, comments=c))


SHAPE_SQL = f"{NUMBERED_SQL}, x AS (SELECT 'o' || l_orderkey AS path, n AS line, l_returnflag = 'R' AS r, l_linestatus = 'F' AS f, l_discount < 0.05 AS a, l_tax < 0.04 AS t, l_suppkey FROM li)"


def _shape(s, d):
    return numbered(s, d).select(name_of("o", "l_orderkey").alias("path"), F.col("n").alias("line"), (F.col("l_returnflag") == "R").alias("r"), (F.col("l_linestatus") == "F").alias("f"), (F.col("l_discount") < 0.05).alias("a"), (F.col("l_tax") < 0.04).alias("t"), "l_suppkey")


def shaped(where: str, text: str, symbol: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"WITH {SHAPE_SQL} SELECT path AS file_path, line AS line_number, 2 AS certainty, {symbol} AS symbol_id, {text} AS message FROM x WHERE {where}"


@query(shaped("r AND NOT f AND a AND t", "'Argument equals the parameter''s default'", "'s' || l_suppkey"))
def rule_default_argument(s, d):
    x = _shape(s, d).select("path", "line", name_of("s", "l_suppkey").alias("symbol_id"), F.col("r").alias("is_last"), F.col("f").alias("named"), F.lit(True).alias("literal"), F.col("a").alias("equals_default"), F.col("t").alias("rebinds_same"))
    return shapes.default_argument(facts(s, invocation_args=x))


@query(shaped("r AND (NOT f OR a)", "'Type arguments can be inferred'"))
def rule_type_arguments(s, d):
    x = _shape(s, d).select("path", "line", F.col("r").alias("inferred_same"), F.when(F.col("a"), F.lit(None)).otherwise(F.col("f")).alias("nullable_or_dynamic"))
    return shapes.type_arguments(facts(s, type_args=x))


@query(shaped("r OR (f AND t)", "CASE WHEN r THEN 'Cast to its own type ''' ELSE 'Cast to a base type ''' END || 'T' || (l_suppkey % 9) || ''''"))
def rule_redundant_cast(s, d):
    x = _shape(s, d).select("path", "line", F.concat(F.lit("T"), (F.col("l_suppkey") % 9).cast("string")).alias("target"), F.col("r").alias("identity"), F.col("f").alias("implicit_reference"), F.col("t").alias("safe_parent"))
    return shapes.redundant_cast(facts(s, casts=x))


@query(shaped("a AND t", "'Qualifier ''N' || (l_suppkey % 9) || ''' is not needed'"))
def rule_redundant_qualifier(s, d):
    x = _shape(s, d).select("path", "line", F.concat(F.lit("N"), (F.col("l_suppkey") % 9).cast("string")).alias("text"), (F.col("a") & F.col("t")).alias("rebinds_same"))
    return shapes.redundant_qualifier(facts(s, qualifiers=x))


@query(f"""WITH {DECL_SQL}, one AS (SELECT k // 3 AS t FROM d WHERE k % 3 <> 0 AND k % 4 <> 3 GROUP BY 1 HAVING count(*) = 1)
SELECT {found(2, "'Empty ' || CASE WHEN k % 4 = 3 THEN 'destructor' ELSE 'constructor' END")} FROM d
WHERE k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND (k % 4 = 3 OR (k % 2 = 0 AND k % 11 <> 0 AND k // 3 IN (SELECT t FROM one) AND (k // 3 * 3) % 13 <> 0))""")
def rule_empty_member(s, d):
    kind = F.when(k_is(3), "type").when(k_is(4, 3), "destructor").otherwise("constructor")
    of = F.when(~k_is(3), F.concat(F.lit("p"), (F.col("k") - F.col("k") % 3).cast("string")))
    decl = declared(s, d, kind=kind, type_id=of, is_abstract=k_is(3) & k_is(13), is_empty=~k_is(5), attributes=F.when(k_is(7), F.array(F.lit("A"))).otherwise(none()), accessibility=F.when(k_is(2), "public").otherwise("internal"), parameters=F.when(k_is(11), 1).otherwise(0))
    return shapes.empty_member(facts(s, declarations=decl))


def _bodies(s, d, kind: Column):
    n = numbered(s, d)
    nodes = n.select(name_of("o", "l_orderkey").alias("body_id"), F.col("n").cast("long").alias("node_id"), F.when(F.col("n") > 1, F.col("n") - 1).cast("long").alias("parent_id"), F.col("n").alias("ord"), kind.alias("kind"), F.col("n").alias("line"))
    o = table(s, d, "orders").select(name_of("o", "o_orderkey").alias("symbol_id"), F.lit("method").alias("kind"), name_of("m", "o_orderkey").alias("name"), F.concat(F.when(F.col("o_orderkey") % 6 == 0, "src/tests/").otherwise("src/"), F.col("o_orderkey").cast("string"), F.lit(".cs")).alias("path"), F.when(F.col("o_orderkey") % 7 == 0, "App.Test").otherwise("App").alias("project"))
    return facts(s, ast_nodes=nodes, declarations=o)


COMPLEX_SQL = "SELECT 'src/' || o_orderkey || '.cs' AS file_path, line AS line_number, 4 AS certainty, 'o' || o_orderkey AS symbol_id, '{what} complexity of m' || o_orderkey || ' is ' || score AS message FROM g JOIN orders ON o_orderkey = l_orderkey WHERE score > {limit} AND o_orderkey % 6 <> 0 AND o_orderkey % 7 <> 0"


@query(f"WITH {NUMBERED_SQL}, g AS (SELECT l_orderkey, min(n) AS line, 1 + count(*) FILTER (WHERE l_returnflag = 'R') AS score FROM li GROUP BY l_orderkey) " + COMPLEX_SQL.format(what="Cyclomatic", limit=3))
def rule_cyclomatic(s, d):
    return shapes.cyclomatic(_bodies(s, d, F.when(F.col("l_returnflag") == "R", "if").otherwise("block")), 3)


@query(
    f"""WITH {NUMBERED_SQL}, x AS (SELECT *, coalesce(sum(CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS deep FROM li),
g AS (SELECT l_orderkey, min(n) AS line, CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 + deep WHEN 'A' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM x GROUP BY l_orderkey) """
    + COMPLEX_SQL.format(what="Cognitive", limit=6)
)
def rule_cognitive(s, d):
    return shapes.cognitive(_bodies(s, d, F.when(F.col("l_returnflag") == "R", "if").when(F.col("l_returnflag") == "A", "else").otherwise("block")), 6)


# ---------------------------------------------------------------- clones

FRAGMENT_SQL = """WITH RECURSIVE tok AS (SELECT 'f' || (doc_id % 7) || '/' || doc_id AS path, [x FOR x IN string_split_regex(text, '[ \\t\\n\\r]+') IF x <> ''] AS t FROM documents),
win AS (SELECT path, i - 1 AS idx, array_to_string(list_slice(t, i, i + 59), chr(31)) AS k FROM (SELECT path, t, unnest(range(1, len(t) - 58)) AS i FROM tok WHERE len(t) >= 60)),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY path, idx) AS r, min(path) OVER (PARTITION BY k) AS a, max(path) OVER (PARTITION BY k) AS b FROM win) WHERE r <= 512 AND a < b),
pr AS (SELECT l.path AS lp, r.path AS rp, l.idx AS li, r.idx AS ri FROM cut l JOIN cut r ON l.k = r.k AND l.path < r.path),
isl AS (SELECT lp, rp, min(li) AS ls, min(ri) AS rs, count(*) + 59 AS len FROM (SELECT *, li - row_number() OVER (PARTITION BY lp, rp, ri - li ORDER BY li) AS g FROM pr) GROUP BY lp, rp, ri - li, g),
mx AS (SELECT lp, rp, ls, rs, len FROM (SELECT *, max(rs + len) OVER (PARTITION BY lp, rp ORDER BY len DESC, ls, rs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM isl) WHERE far IS NULL OR rs + len > far),
lg AS (SELECT * FROM mx WHERE (ls + len - 1) // 8 - ls // 8 + 1 >= 4 AND (rs + len - 1) // 8 - rs // 8 + 1 >= 4),
sy AS (SELECT {'path': lp, 'start': ls, 'len': len} AS a, {'path': rp, 'start': rs, 'len': len} AS b FROM lg UNION SELECT {'path': rp, 'start': rs, 'len': len}, {'path': lp, 'start': ls, 'len': len} FROM lg),
reach AS (SELECT a AS node, a AS root FROM sy UNION SELECT sy.b, reach.root FROM reach JOIN sy ON sy.a = reach.node),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node),
mem AS (SELECT c, node.path AS path, min(node.start) AS start FROM comp GROUP BY c, node.path),
st AS (SELECT c, count(*) AS n, min({'path': path, 'line': start // 8 + 1}) AS f, count(DISTINCT string_split(path, '/')[1]) AS folders FROM mem GROUP BY c)
SELECT f.path AS file_path, CAST(f.line AS INTEGER) AS line_number, 4 AS certainty, CAST(NULL AS VARCHAR) AS symbol_id, 'Fragment occurs in ' || n || ' files' AS message FROM st WHERE n >= 2 AND folders >= 2"""


@query(FRAGMENT_SQL)
def rule_duplicated(s, d):
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda x: x != "")
    path = F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    t = table(s, d, "documents").where("text is not null").select(path.alias("path"), F.posexplode(words).alias("idx", "tok"))
    return shapes.duplicated(facts(s, tokens=t.withColumn("line", F.expr("idx div 8 + 1").cast("int"))))
