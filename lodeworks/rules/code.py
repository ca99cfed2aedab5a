"""Rules on declarations and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators import relations
from lodeworks.operators.closure import closure
from lodeworks.operators.graph import connected_components
from lodeworks.rules import ADVISORY, GUARANTEED, HIGH, MODERATE, finding, rule
from lodeworks.sources.facts import SERIALIZATION_ATTRIBUTES, Facts, carries


def _named(text: str):
    return F.concat(F.lit(text + " '"), F.col("name"), F.lit("'"))


def _unreferenced(facts: Facts, declared: DataFrame) -> DataFrame:
    return relations.unreferenced(declared, facts["references"], "symbol_id")


@rule("R0001", "Unused private member")
def unused_private(facts: Facts) -> DataFrame:
    d = facts.live_declarations.where("accessibility = 'private' and kind in ('method', 'property', 'field', 'local_function', 'indexer')")
    d = d.where(~carries("attributes", SERIALIZATION_ATTRIBUTES)).join(facts["implements"], "symbol_id", "left_anti")
    return finding(_unreferenced(facts, d), "R0001", GUARANTEED, F.concat(F.lit("Private "), "kind", _named("")), symbol="symbol_id", ch="ch")


@rule("R0002", "Unreachable code")
def unreachable(facts: Facts) -> DataFrame:
    s = facts["statements"].where("kind not in ('empty', 'local_function')")
    w = Window.partitionBy("block_id").orderBy("ord")
    behind = F.coalesce(F.max(F.col("exits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False))
    dead = s.withColumn("dead", behind | ~F.coalesce("start_reachable", F.lit(True))).where("dead")
    first = dead.withColumn("r", F.row_number().over(w)).where("r = 1")
    return finding(first, "R0002", GUARANTEED, F.lit("Statement can never run"), ch="ch")


def _non_private(facts: Facts, access: str, rule_id: str) -> DataFrame:
    d = facts.live_declarations.where((F.col("accessibility") == access) & F.col("kind").isin("type", "method", "property"))
    unused = _unreferenced(facts, d).join(relations.contract_live(facts["implements"], facts["references"]), "symbol_id", "left_anti")
    unused = unused.where("not is_override")
    # what a container makes, and what can be called from outside, may have users that are not seen
    made = facts["type_edges"].where("via = 'di'").select(F.col("used_type_id").alias("type_id"), F.lit(True).alias("made")).distinct()
    around = facts["declarations"].where("kind = 'type'").select(F.col("symbol_id").alias("type_id"), F.col("accessibility").alias("around"))
    unused = unused.join(made, "type_id", "left").join(around, "type_id", "left")
    exported = F.lit(access == "public") & ((F.col("kind") == "type") | (F.col("around") == "public"))
    weaker = F.coalesce("has_friends", F.lit(False)) | F.coalesce("made", F.lit(False)) | F.coalesce(exported, F.lit(False))
    return finding(unused, rule_id, F.when(weaker, ADVISORY).otherwise(MODERATE), F.concat(F.lit(access.capitalize() + " "), "kind", _named("")), symbol="symbol_id", ch="ch")


@rule("R0005", "Unused internal member")
def unused_internal(facts: Facts) -> DataFrame:
    return _non_private(facts, "internal", "R0005")


@rule("R0006", "Unused public member")
def unused_public(facts: Facts) -> DataFrame:
    found = _non_private(facts, "public", "R0006")
    # types a serializer reaches, and static types whose extension method is used
    seeds = facts["type_edges"].where("via = 'serialized'").select(F.col("used_type_id").alias("root"))
    reach = closure(facts["type_edges"].where("via <> 'serialized'").select(F.col("type_id").alias("src"), F.col("used_type_id").alias("dst")), roots=seeds)
    types = seeds.select(F.col("root").alias("type_id")).union(reach.select("node"))
    members = facts["declarations"].join(types.distinct(), "type_id", "left_semi").select("symbol_id").union(types.select(F.col("type_id")))
    used_extension = facts["declarations"].where("kind = 'method' and is_static").join(facts["references"], "symbol_id", "left_semi").select(F.col("type_id").alias("symbol_id"))
    return found.join(members.union(used_extension).distinct(), "symbol_id", "left_anti").select(found.columns)


@rule("R0009", "Unused local variable")
def unused_local(facts: Facts) -> DataFrame:
    d = facts["declarations"].where("kind = 'local' and name <> '_'")
    reads = facts["references"].where("kind = 'read'")
    return finding(relations.unreferenced(d, reads, "symbol_id"), "R0009", GUARANTEED, _named("Local"), symbol="symbol_id", ch="ch")


@rule("R0010", "Unused parameter")
def unused_parameter(facts: Facts) -> DataFrame:
    owner = facts["declarations"].where("kind in ('method', 'local_function') and accessibility = 'private'")
    direct = facts["references"].groupBy("symbol_id").agg(F.bool_and("is_direct_invocation").alias("direct")).where("direct").select(F.col("symbol_id").alias("type_id"))
    owners = owner.select(F.col("symbol_id").alias("type_id")).join(direct, "type_id", "left_semi")
    p = facts["declarations"].where("kind = 'parameter'").join(owners, "type_id", "left_semi")
    return finding(_unreferenced(facts, p), "R0010", MODERATE, _named("Parameter"), symbol="symbol_id", ch="ch")


@rule("R0018", "Unused obsolete member")
def obsolete_member(facts: Facts) -> DataFrame:
    d = facts.judged(but=("Obsolete",)).where(carries("attributes", ("Obsolete", "ObsoleteError")) & ~F.col("is_override"))
    d = d.join(facts["implements"], "symbol_id", "left_anti")
    strong = carries("attributes", ("ObsoleteError",)) | (F.col("accessibility") != "public")
    tier = F.when(F.col("kind") == "enum_member", ADVISORY).when(strong, HIGH).otherwise(MODERATE)
    return finding(_unreferenced(facts, d), "R0018", tier, _named("Obsolete"), symbol="symbol_id", ch="ch")


@rule("R0019", "Unused using directive")
def unused_using(facts: Facts) -> DataFrame:
    u = facts["usings"]
    w = Window.partitionBy("path", "name", "is_global", "is_static", F.coalesce("alias", F.lit(""))).orderBy("pos")
    u = u.withColumn("again", F.row_number().over(w) > 1).where("diagnostic in ('CS8019', 'CS8933')")
    one = Window.partitionBy("path", "pos").orderBy(F.when(F.col("diagnostic") == "CS8933", 0).otherwise(1))
    u = u.withColumn("r", F.row_number().over(one)).where("r = 1")
    text = F.when(F.col("again"), "Repeated using '").when(F.col("diagnostic") == "CS8933", "Using appears as a global one '").otherwise("Unnecessary using '")
    return finding(u, "R0019", GUARANTEED, F.concat(text, "name", F.lit("'")))


@rule("R0021", "Write-only field")
def write_only(facts: Facts) -> DataFrame:
    f = facts["declarations"].where("kind = 'field' and accessibility = 'private' and not array_contains(coalesce(attributes, cast(array() as array<string>)), 'const')")
    f = f.where(~carries("attributes", SERIALIZATION_ATTRIBUTES))
    use = facts["references"].where("kind <> 'nameof'").groupBy("symbol_id").agg(
        F.bool_or((F.col("kind").isin("read", "readwrite")) | F.coalesce("is_candidate", F.lit(False))).alias("read"), F.bool_or(F.col("kind").isin("write", "readwrite")).alias("written")
    )
    return finding(f.join(use.where("written and not read"), "symbol_id"), "R0021", HIGH, _named("Never read field"), symbol="symbol_id", ch="ch")


@rule("R0023", "Virtual member never overridden")
def never_overridden(facts: Facts) -> DataFrame:
    d = facts["declarations"]
    used = facts["references"].select("symbol_id").distinct()
    virtual = d.where("is_virtual and not is_override and accessibility <> 'private'")
    types = d.where("kind = 'type' and not is_sealed and not is_abstract").join(virtual.select(F.col("type_id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    lonely = types.join(facts["inherits"].select(F.col("base_id").alias("symbol_id")), "symbol_id", "left_anti").join(used, "symbol_id", "left_semi")
    whole = finding(lonely, "R0023", MODERATE, _named("Class with virtual members is never inherited"), symbol="symbol_id", ch="ch")
    members = virtual.join(lonely.select(F.col("symbol_id").alias("type_id")), "type_id", "left_anti").join(used, "symbol_id", "left_semi")
    members = members.join(facts["overrides"].select(F.col("base_symbol_id").alias("symbol_id")), "symbol_id", "left_anti")
    return whole.unionByName(finding(members, "R0023", ADVISORY, _named("Virtual member is never overridden"), symbol="symbol_id", ch="ch"))


@rule("R0024", "Member can be tightened")
def tighten(facts: Facts) -> DataFrame:
    d, refs = facts["declarations"], facts["references"]
    # uses_instance: whether a method's body touches this, base or an instance member; null where that isn't known
    static = d.where("kind = 'method' and not is_static and not is_virtual and not is_override and not is_abstract and not uses_instance and size(coalesce(attributes, cast(array() as array<string>))) = 0")
    static = static.join(facts["implements"], "symbol_id", "left_anti")
    fields = d.where("kind = 'field' and accessibility = 'private' and not array_contains(coalesce(attributes, cast(array() as array<string>)), 'readonly')")
    written = refs.where("kind in ('write', 'readwrite')").select("symbol_id").distinct()
    outside = refs.where("kind = 'write_outside_constructor' or kind = 'readwrite'").select("symbol_id").distinct()
    readonly = fields.join(written, "symbol_id", "left_semi").join(outside, "symbol_id", "left_anti")
    sealed = d.where("kind = 'type' and accessibility <> 'public' and not is_sealed and not is_abstract and not is_static").join(facts["inherits"].select(F.col("base_id").alias("symbol_id")), "symbol_id", "left_anti")
    types = d.where("kind = 'type'").select(F.col("symbol_id").alias("type_id"), F.col("path").alias("type_path"), F.col("line").alias("lo"), F.col("span_end").alias("hi"))
    inner = d.where("kind in ('method', 'property', 'field') and accessibility = 'internal' and not is_virtual and not is_override").join(types, "type_id")
    inner = inner.join(facts["implements"], "symbol_id", "left_anti")
    at = refs.select("symbol_id", F.col("path").alias("ref_path"), F.col("line").alias("ref_line"))
    seen = inner.join(at, "symbol_id").withColumn("out", (F.col("ref_path") != F.col("type_path")) | ~F.col("ref_line").between(F.col("lo"), F.col("hi")))
    closed = seen.groupBy("symbol_id").agg(F.max("out").alias("out")).where("not out").select("symbol_id")
    private = inner.join(closed, "symbol_id", "left_semi")
    parts = [finding(x, "R0024", ADVISORY, _named(t), symbol="symbol_id", ch="ch") for x, t in ((static, "Can be static:"), (readonly, "Can be readonly:"), (sealed, "Can be sealed:"), (private, "Can be private:"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@rule("R0027", "Override family used only by itself")
def closed_family(facts: Facts) -> DataFrame:
    d = facts["declarations"]
    o = facts["overrides"]
    family = connected_components(o, "symbol_id", "base_symbol_id").withColumnsRenamed({"node": "symbol_id", "component": "family"})
    members = d.join(family, "symbol_id").select("symbol_id", "family", "name", "path", "line", "ch", "span_end", "is_abstract", "accessibility", "has_friends")
    spans = members.select("family", F.col("path").alias("span_path"), F.col("line").alias("lo"), F.col("span_end").alias("hi"))
    at = facts["references"].join(family, "symbol_id").select("family", F.col("path").alias("ref_path"), F.col("line").alias("ref_line"), F.monotonically_increasing_id().alias("ref"))
    inside = at.join(spans, (at["family"] == spans["family"]) & (F.col("ref_path") == F.col("span_path")) & F.col("ref_line").between(F.col("lo"), F.col("hi")), "left_semi")
    total, within = at.groupBy("family").agg(F.count("*").alias("n")), inside.groupBy("family").agg(F.count("*").alias("k"))
    closed = total.join(within, "family").where("n = k").select("family")
    ok = members.groupBy("family").agg(F.count("*").alias("size"), F.bool_or("is_abstract").alias("abstract")).where("size >= 2 and not abstract").join(closed, "family", "left_semi")
    roots = members.join(ok, "family", "left_semi").join(o.select("symbol_id"), "symbol_id", "left_anti")
    spelled = facts["string_literals"].select(F.col("text").alias("name")).distinct()
    candidate = facts["references"].where("is_candidate").join(family, "symbol_id").select("family")  # not known to be one: no finding
    roots = roots.join(candidate, "family", "left_anti")
    return finding(roots.join(spelled, "name", "left_anti"), "R0027", F.when(F.coalesce("has_friends", F.lit(False)) | (F.col("accessibility") == "public"), ADVISORY).otherwise(MODERATE), _named("Overrides call only each other:"), symbol="symbol_id", ch="ch")


@rule("R0030", "Event never raised")
def event_never_raised(facts: Facts) -> DataFrame:
    e = facts["declarations"].where("kind = 'event' and not is_abstract and not is_override").join(facts["implements"], "symbol_id", "left_anti")
    raised = facts["references"].where("not coalesce(is_subscription, false)").select("symbol_id")
    return finding(e.join(raised, "symbol_id", "left_anti"), "R0030", ADVISORY, _named("Event"), symbol="symbol_id", ch="ch")
