"""Project files, lock files and folders as fact tables."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRUNED = ("bin", "obj", ".git", ".vs", "node_modules")


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text) of files below a folder, build and tool folders left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    inner = F.split(F.lower("path"), "/")
    pruned = F.exists(F.slice(inner, F.lit(1), F.size(inner) - 1), lambda s: s.isin(*PRUNED))
    return f.where(~pruned).select("path", F.col("content").cast("string").alias("text"))


def not_own_report(files: DataFrame) -> DataFrame:
    """JSON files without a report of ours: one has ``"ruleId"`` among its first 4096 characters."""
    return files.where(~F.substring("text", 1, 4096).contains('"ruleId"'))


def _well_formed():
    def check(text: pd.Series) -> pd.Series:
        def fine(t: str | None) -> bool:
            parser = expat.ParserCreate()
            try:
                parser.Parse((t or "").encode(), True)
            except (expat.ExpatError, LookupError, ValueError):
                return False
            return True

        return text.map(fine).astype(bool)

    return F.pandas_udf(check, "boolean")


def _first(xml: str, *paths: str):
    return F.coalesce(*(F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit("")) for p in paths))


def _attribute(item, *names: str):
    out = [F.nullif(F.regexp_extract(item, rf'(?s)^<[^>]*?\b{n}\s*=\s*"([^"]*)"', 1), F.lit("")) for n in names]
    return F.coalesce(*out)


def _element(item, name: str):
    return F.nullif(F.trim(F.regexp_extract(item, rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)), F.lit(""))


def _items(files: DataFrame, name: str) -> DataFrame:
    """(path, item, line): the elements called ``name``, self-closed or not, with their lines."""
    # of a comment its line breaks stay, so that lines count
    split = F.split("text", r"(?s)(?=<!--)|(?<=-->)")
    text = F.array_join(F.transform(split, lambda x: F.when(x.startswith("<!--"), F.regexp_replace(x, r"[^\n]+", "")).otherwise(x)), "")
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).*?(<{name}\b(?:[^>]*?/>|[^>]*>.*?</{name}>))"), F.lit(0))
    before = F.transform(pieces, lambda p, i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))))
    rows = files.select("path", F.posexplode(F.arrays_zip(pieces.alias("p"), before.alias("n"))).alias("i", "z"))
    item = F.regexp_extract("z.p", rf"(?s)(<{name}\b.*)$", 1)
    lead = F.regexp_extract("z.p", rf"(?s)^(.*?)<{name}\b", 1)
    return rows.select("path", item.alias("item"), (F.col("z.n") + F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line"))


def read_projects(files: DataFrame) -> dict[str, DataFrame]:
    """projects, package_refs and project_refs of project files (path, text). A file that isn't well-formed XML is left out; commented-out parts don't count."""
    files = files.withColumn("text", F.regexp_replace("text", "^\\uFEFF", ""))
    files = files.withColumn("text", F.when(_well_formed()(F.col("text")), F.col("text"))).where("text is not null")
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    p = files.withColumn("xml", F.regexp_replace("text", r'\sxmlns="[^"]*"', ""))
    tfms = F.flatten(F.array_compact(F.array(F.array(_first("xml", "//TargetFramework")), F.split(_first("xml", "//TargetFrameworks"), r"\s*;\s*"))))
    tfms = F.array_compact(tfms)
    frameworks = F.expr("xpath(xml, '//FrameworkReference/@Include')")
    packages = F.expr("xpath(xml, '//PackageReference/@Include')")
    test = (F.lower(F.coalesce(_first("xml", "//IsTestProject"), F.lit(""))) == "true") | F.exists(packages, lambda x: F.lower(x).isin("microsoft.net.test.sdk", "microsoft.testing.platform"))
    projects = p.select(
        "path", F.coalesce(_first("xml", "//AssemblyName"), stem).alias("assembly_name"), _first("xml", "/Project/@Sdk", "//Sdk/@Name").alias("sdk"), _first("xml", "//OutputType").alias("output_type"),
        test.alias("is_test"), F.lit(True).alias("is_loaded"), F.coalesce(F.filter(tfms, lambda x: x != ""), F.array().cast("array<string>")).alias("tfms"), frameworks.alias("framework_refs"),
    )
    k = _items(files, "PackageReference")
    private = F.lower(F.coalesce(_attribute("item", "PrivateAssets"), _element("item", "PrivateAssets"), F.lit(""))) == "all"
    excluded = F.lower(F.coalesce(_attribute("item", "ExcludeAssets"), _element("item", "ExcludeAssets"), F.lit(""))).contains("compile")
    version = F.coalesce(_attribute("item", "VersionOverride"), _attribute("item", "Version"), _element("item", "Version"))
    version = F.nullif(F.regexp_extract(version, r"^\s*[\[(]?\s*([^,\])\s]+)", 1), F.lit(""))  # a range's lower bound
    package_refs = k.select("path", _attribute("item", "Include", "Update").alias("id"), version.alias("min_version"), excluded.alias("compile_excluded"), private.alias("private_all"), "line").where("id is not null")
    r = _items(files, "ProjectReference")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    target = F.concat(folder, F.replace(_attribute("item", "Include"), F.lit("\\"), F.lit("/")))
    project_refs = r.select(
        "path", resolve(target).alias("ref_path"), (F.lower(F.coalesce(_attribute("item", "PrivateAssets"), _element("item", "PrivateAssets"), F.lit(""))) == "all").alias("private_all"),
        (F.lower(F.coalesce(_attribute("item", "ReferenceOutputAssembly"), _element("item", "ReferenceOutputAssembly"), F.lit(""))) == "false").alias("output_disabled"),
        (F.lower(F.coalesce(_attribute("item", "OutputItemType"), _element("item", "OutputItemType"), F.lit(""))) == "analyzer").alias("is_analyzer"), "line",
    ).where("ref_path is not null")
    return {"projects": projects, "package_refs": package_refs, "project_refs": project_refs}


def resolve(path):
    """A path without ``.`` and ``x/..``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    return F.array_join(up, "/")


def read_lock(files: DataFrame) -> dict[str, DataFrame]:
    """lock_packages and lock_deps of assets files (path, text): targets -> package/version -> dependencies, packages only."""
    kind = "struct<targets:map<string,map<string,struct<type:string,dependencies:map<string,string>>>>>"
    t = files.select("path", F.explode(F.from_json("text", kind)["targets"]).alias("tfm", "packages")).select("path", "tfm", F.explode("packages").alias("key", "p")).where("p.type = 'package'")
    t = t.select("path", "tfm", F.split("key", "/")[0].alias("id"), F.get(F.split("key", "/"), F.lit(1)).alias("version"), F.col("p.dependencies").alias("d"))
    deps = t.select("path", "tfm", "id", F.explode("d").alias("dep_id", "min_version")).withColumn("min_version", F.regexp_extract("min_version", r"^[\[(]?\s*([^,\])]+)", 1))
    return {"lock_packages": t.drop("d"), "lock_deps": deps}


def read_inbox(files: DataFrame, tfm: str, aspnet: bool) -> DataFrame:
    """inbox_packages of override lists (text of ``id|version`` lines): the largest version of each id."""
    from lodeworks.functions.text import version_struct

    rows = files.select(F.explode(F.split("text", r"\r?\n")).alias("l")).select(F.lower(F.trim(F.split("l", r"\|")[0])).alias("id"), F.trim(F.get(F.split("l", r"\|"), F.lit(1))).alias("version")).where("version is not null and id <> ''")
    return rows.groupBy("id").agg(F.max_by("version", version_struct(F.col("version"))).alias("version")).select(F.lit(tfm).alias("tfm"), F.lit(aspnet).alias("aspnet"), "id", "version")


def read_numstat(lines: DataFrame) -> DataFrame:
    """numstat of ``added<TAB>deleted<TAB>path`` lines (text); binary rows and others are left out."""
    p = F.split("text", "\t", 3)
    return lines.where(F.size(p) == 3).select(p[2].alias("path"), p[0].try_cast("int").alias("added"), p[1].try_cast("int").alias("deleted")).where("added is not null and deleted is not null")


def read_stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored JSON lines (baseline, ledger); one that is missing is empty, broken lines are left out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def detached(loaded: DataFrame, on_disk: DataFrame) -> DataFrame:
    """projects, is_loaded told by whether the solution holds the path (case-blind). loaded: (path); on_disk: projects."""
    known = loaded.select(F.lower("path").alias("_p")).distinct().withColumn("_l", F.lit(True))
    return on_disk.join(known, F.lower("path") == F.col("_p"), "left").withColumn("is_loaded", F.coalesce("_l", F.lit(False))).select(on_disk.columns)


def newest_patch(folders: DataFrame) -> DataFrame:
    """(major, path): of folders named by a version (path ends in ``/8.0.3``) the highest of each major, previews last."""
    from lodeworks.functions.text import version_struct

    name = F.regexp_extract("path", r"([^/\\]+)[/\\]?$", 1)
    v = folders.withColumn("_v", version_struct(name)).where(name.rlike(r"^\d+\."))
    return v.groupBy(F.col("_v.major").alias("major")).agg(F.max_by("path", "_v").alias("path"))
