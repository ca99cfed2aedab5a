"""Rules on projects, packages and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import version_struct
from lodeworks.operators.closure import closure, everywhere
from lodeworks.rules import ADVISORY, HIGH, MODERATE, finding, rule
from lodeworks.sources.facts import Facts
from lodeworks.sources.shared import stage


def flow(facts: Facts) -> DataFrame:
    """(path, assembly): what a project brings along: its own assembly, its packages', and those of what it references."""
    own = facts["projects"].select("path", F.col("assembly_name").alias("assembly")).union(facts["package_assemblies"].select("path", "assembly"))
    reach = closure(facts["project_refs"].select(F.col("path").alias("src"), F.col("ref_path").alias("dst"))).select(F.col("root").alias("to"), F.col("node").alias("path"))
    return own.union(reach.join(own, "path").select("to", "assembly")).distinct()


def package_subtree(facts: Facts) -> DataFrame:
    """(path, id, node): packages that only the direct package ``id`` of a project brings in, other direct ones among them.

    What another direct package reaches, by ``id`` too if it needs that, stays when ``id`` goes; so a package is exclusive when one direct package
    alone reaches it.
    """
    direct = facts["package_refs"].select("path", F.lower("id").alias("id")).distinct()
    deps = facts["lock_deps"].select("path", F.lower("id").alias("id"), F.lower("dep_id").alias("dep")).distinct()
    node = lambda p, i: F.struct(F.col(p).alias("path"), F.col(i).alias("id"))
    edges = deps.select(node("path", "id").alias("src"), node("path", "dep").alias("dst"))
    reach = closure(edges, roots=direct.select(node("path", "id").alias("root"))).select("root", "node")
    shared = reach.groupBy("node").agg(F.count("*").alias("n"), F.min("root").alias("root")).where("n = 1")
    return shared.select(F.col("root.path").alias("path"), F.col("root.id").alias("id"), F.col("node.id").alias("node"))


def unused_packages(facts: Facts) -> DataFrame:
    """package_refs of which neither the package, nor what it alone brings in, nor (not private) a consumer's use shows."""
    refs = facts["package_refs"].where("not coalesce(compile_excluded, false)").withColumn("pid", F.lower("id"))
    known = facts["package_assemblies"].select("path", F.lower("id").alias("pid"), "assembly").distinct()
    used = facts["used_assemblies"].select("path", "assembly").distinct()
    live = known.join(used, ["path", "assembly"], "left_semi").select("path", "pid")
    below = package_subtree(facts).select("path", F.col("id").alias("pid"), "node")
    below = below.join(known.withColumnRenamed("pid", "node"), ["path", "node"]).join(used, ["path", "assembly"], "left_semi").select("path", "pid")
    out = refs.join(known.select("path", "pid").distinct(), ["path", "pid"], "left_semi").join(live.union(below), ["path", "pid"], "left_anti")
    theirs = used.select(F.col("path").alias("node"), "assembly")
    passed = known.join(facts.consumers.withColumnRenamed("root", "path"), "path").join(theirs, ["node", "assembly"], "left_semi").select("path", "pid").withColumn("private_all", F.lit(False))
    return out.withColumn("private_all", F.coalesce("private_all", F.lit(False))).join(passed, ["path", "pid", "private_all"], "left_anti")


@rule("R0003", "Unused package reference")
def unused_package(facts: Facts) -> DataFrame:
    found = unused_packages(facts)
    # a project that is not loaded may use what it gets
    unloaded = facts["projects"].where("not is_loaded").select(F.col("path").alias("node"))
    may = facts.consumers.join(unloaded, "node", "left_semi").select(F.col("root").alias("path"), F.lit(True).alias("may")).distinct()
    found = found.join(may, "path", "left")
    return finding(found, "R0003", F.when(F.col("may") & ~F.col("private_all"), MODERATE).otherwise(HIGH), F.concat(F.lit("Package '"), "id", F.lit("' is not used")))


@rule("R0004", "Unused project reference")
def unused_project(facts: Facts) -> DataFrame:
    refs = facts["project_refs"].where("not coalesce(output_disabled, false) and not coalesce(is_analyzer, false)")
    names = facts["projects"].where("is_loaded").select(F.col("path").alias("ref_path"), "assembly_name")
    refs = refs.join(names, "ref_path").withColumn("private_all", F.coalesce("private_all", F.lit(False)))
    used = facts["used_assemblies"].select("path", "assembly").distinct()
    direct = refs.join(used.withColumnRenamed("assembly", "assembly_name"), ["path", "assembly_name"], "left_anti")
    brings = stage(flow(facts), "brings").withColumnRenamed("path", "ref_path")
    # what the project uses and gets by one reference only, and by no package
    got = refs.select("path", "ref_path").join(brings.hint("merge"), "ref_path").join(used, ["path", "assembly"], "left_semi")
    only = got.groupBy("path", "assembly").agg(F.min("ref_path").alias("ref_path"), F.max("ref_path").alias("_other")).where("ref_path = _other")
    needed = only.join(facts["package_assemblies"].select("path", "assembly"), ["path", "assembly"], "left_anti").select("path", "ref_path")
    # what those use that get it from the project
    theirs = facts.consumers.select(F.col("root").alias("path"), "node").join(used.withColumnRenamed("path", "node").hint("merge"), "node").select("path", "assembly").distinct()
    lost = direct.where("not private_all").select("path", "ref_path").join(brings.hint("merge"), "ref_path")
    passed = lost.join(theirs.hint("merge"), ["path", "assembly"], "left_semi").select("path", "ref_path").withColumn("private_all", F.lit(False))
    out = direct.join(needed, ["path", "ref_path"], "left_anti").join(passed, ["path", "ref_path", "private_all"], "left_anti")
    unloaded = facts["projects"].where("not is_loaded").select(F.col("path").alias("node"))
    may = facts.consumers.join(unloaded, "node", "left_semi").select(F.col("root").alias("path"), F.lit(True).alias("may")).distinct()
    out = out.join(may, "path", "left")
    return finding(out, "R0004", F.when(F.col("may") & ~F.col("private_all"), MODERATE).otherwise(HIGH), F.concat(F.lit("Project reference '"), "ref_path", F.lit("' is not used")))


def spelled(names: DataFrame, texts: DataFrame, name: str = "assembly_name") -> DataFrame:
    """Rows of ``names`` whose name a text contains, inside a longer word too, but for texts of their own path; names under three characters count as spelled.

    A name's first three characters meet all rows of three of a text, the substring is looked for in what is left.
    """
    n = names.where(F.length(name) >= 3).select("path", name, F.substring(name, 1, 3).alias("_g"))
    grams = F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    t = texts.select(F.col("path").alias("_p"), F.col("text").alias("_t"), F.explode(grams).alias("_x"))
    hit = n.join(t, (F.col("_g") == F.col("_x")) & ~F.col("path").eqNullSafe(F.col("_p"))).where(F.contains("_t", name)).select("path")
    return names.where(F.length(name) < 3).select("path").union(hit).distinct()


@rule("R0011", "Orphan project")
def orphan(facts: Facts) -> DataFrame:
    p = facts["projects"]
    inbound = facts["project_refs"].groupBy(F.col("ref_path").alias("path")).agg(F.count("*").alias("n"))
    entry = F.lower(F.coalesce("output_type", F.lit(""))).isin("exe", "winexe") | F.coalesce(F.col("sdk").contains("Web"), F.lit(False)) | F.coalesce(F.col("sdk").contains("Worker"), F.lit(False))
    alone = p.join(inbound, "path", "left").where(F.coalesce("n", F.lit(0)) == 0).where(~F.coalesce("is_test", F.lit(False)) & ~entry)
    alone = alone.join(spelled(alone, facts["spelled_names"]), "path", "left_anti")
    detached = ~F.coalesce("is_loaded", F.lit(True))
    return finding(alone, "R0011", MODERATE, F.concat(F.when(detached, "Project outside the solution: '").otherwise("Nothing references project '"), "assembly_name", F.lit("'")), line=F.lit(1))


def redundant_rows(facts: Facts) -> DataFrame:
    """(path, tfm, id, ok): whether another direct package asks for this one in a version as high as the direct one."""
    direct = facts["package_refs"].select("path", F.lower("id").alias("id")).distinct()
    locked = facts["lock_packages"].select("path", "tfm", F.lower("id").alias("id"), "version")
    deps = facts["lock_deps"].select("path", "tfm", F.lower("id").alias("id"), F.lower("dep_id").alias("dep"), "min_version")
    node = lambda i: F.struct("path", "tfm", F.col(i).alias("id"))
    here = direct.join(locked, ["path", "id"])
    reach = closure(deps.select(node("id").alias("src"), node("dep").alias("dst")), roots=here.select(node("id").alias("root"))).select("root", F.col("node").alias("at"))
    at = reach.union(here.select(node("id"), node("id")))
    asked = at.join(deps.select(node("id").alias("at"), node("dep").alias("node"), version_struct(F.col("min_version")).alias("v")), "at").where("root <> node and at <> node")
    best = asked.groupBy("node").agg(F.max("v").alias("v"))
    mine = here.select(node("id").alias("node"), version_struct(F.col("version")).alias("mine"))
    return mine.join(best, "node", "left").select("node.path", "node.tfm", "node.id", F.coalesce(F.col("v") >= F.col("mine"), F.lit(False)).alias("ok"))


@rule("R0012", "Redundant transitive package")
def redundant_package(facts: Facts) -> DataFrame:
    ok = everywhere(redundant_rows(facts), ["path", "id"], ["tfm"], "ok").select("path", F.col("id").alias("pid"))
    many = facts["package_refs"].groupBy("path").agg(F.countDistinct(F.lower("id")).alias("n")).where("n >= 2").select("path")
    refs = facts["package_refs"].withColumn("pid", F.lower("id")).join(ok, ["path", "pid"], "left_semi").join(many, "path", "left_semi")
    refs = refs.join(unused_packages(facts).select("path", "pid"), ["path", "pid"], "left_anti")
    return finding(refs, "R0012", MODERATE, F.concat(F.lit("Package '"), "id", F.lit("' comes with another package")))


@rule("R0013", "Package is part of the framework")
def inbox_package(facts: Facts) -> DataFrame:
    tfms = facts["projects"].select("path", F.explode("tfms").alias("tfm"), F.exists(F.coalesce("framework_refs", F.array().cast("array<string>")), lambda f: f.contains("AspNetCore")).alias("asp"))
    known = facts["inbox_packages"].groupBy("tfm", "aspnet", F.lower("id").alias("pid")).agg(F.max(version_struct(F.col("version"))).alias("v"))
    judged = tfms.join(known.select("tfm").distinct(), "tfm", "left_anti").select("path")  # a framework without a list: not judged
    refs = facts["package_refs"].withColumn("pid", F.lower("id")).join(judged, "path", "left_anti")
    rows = refs.join(tfms, "path").join(known, ["tfm", "pid"], "left").withColumn("ok", F.coalesce((F.col("v") >= version_struct(F.col("min_version"))) & (~F.col("aspnet") | F.col("asp")), F.lit(False)))
    ok = everywhere(rows, ["path", "pid"], ["tfm"], "ok").select("path", "pid")
    return finding(refs.join(ok, ["path", "pid"], "left_semi"), "R0013", HIGH, F.concat(F.lit("Package '"), "id", F.lit("' is part of the framework")))


def _options(facts: Facts) -> tuple[DataFrame, DataFrame]:
    return facts["config_leaves"], facts["option_leaves"]


# Sections whose keys the framework reads itself.
FRAMEWORK_SECTIONS = ("AllowedHosts", "ApplicationInsights", "ConnectionStrings", "Kestrel", "Logging", "NLog", "OpenTelemetry", "Serilog")


@rule("R0007", "Configuration key bound to nothing", opt_in="config_analysis")
def unbound_key(facts: Facts) -> DataFrame:
    from lodeworks.operators.relations import suffix_unbound

    leaves, options = _options(facts)
    keys = leaves.where(~F.lower(F.split("key", ":")[0]).isin(*map(str.lower, FRAMEWORK_SECTIONS)))
    paths = options.select(F.concat_ws(":", F.when(F.col("path") != "", F.col("path")), "property").alias("path"))
    rows = suffix_unbound(keys, paths)
    if paths.isEmpty():  # without options there is nothing to bind to
        rows = rows.limit(0)
    return finding(rows, "R0007", ADVISORY, F.concat(F.lit("Key '"), "key", F.lit("' is bound to no option")), path="file")


@rule("R0008", "Option never configured", opt_in="config_analysis")
def unset_option(facts: Facts) -> DataFrame:
    leaves, options = _options(facts)
    segments = leaves.select(F.lower(F.element_at(F.split("key", ":"), -1)).alias("n")).distinct()
    rows = options.join(segments, F.lower("property") == F.col("n"), "left_anti")
    if leaves.isEmpty():  # without settings nothing is configured
        rows = rows.limit(0)
    return finding(rows, "R0008", ADVISORY, F.concat(F.lit("Option '"), "property", F.lit("' is never configured")), path="type_id", line=F.lit(1))
