"""JSON and SARIF reports, console tables, exit codes."""

from __future__ import annotations

import enum
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.findings import ORDER, TIER_NAMES
from lodeworks.operators.order import number_rows

# The categories' names by number, from 1.
CATEGORIES = (
    "UnreachableCode", "UnusedPrivateMember", "UnusedInternalMember", "UnusedPublicMember", "UnreferencedPackage", "UnreferencedProject", "UnusedConfigurationSetting",
    "UnusedLocalVariable", "UnusedParameter", "OrphanProject", "RedundantTransitivePackage", "FrameworkProvidedPackage", "ObsoleteUnreferencedMember", "UnusedUsingDirective",
    "CommentedOutCode", "WriteOnlyField", "RedundantArgument", "RedundantTypeArguments", "HierarchyDeadCode", "Tightening", "RedundantCast", "RedundantQualifier",
    "EmptyTypeMember", "UnusedEvent", "DuplicateFragment", "CloneDrift", "Complexity",
)
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
LAST = 1 << 62


class Exit(enum.IntEnum):
    OK, USAGE, WRITE_FAILED, OVER_BUDGET = range(4)


def exit_code(opened: bool = True, written: bool = True, over_budget: bool = False) -> Exit:
    """Findings never fail a run; a failed write comes before a breached budget."""
    return Exit.USAGE if not opened else Exit.WRITE_FAILED if not written else Exit.OVER_BUDGET if over_budget else Exit.OK


def tier_name(certainty: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TIER_NAMES.items():
        out = F.when(certainty == k, v.capitalize()).otherwise(out)
    return out


def category_name(category: Column) -> Column:
    return F.get(F.array(*map(F.lit, CATEGORIES)), category.cast("int") - 1)


def with_line_text(findings: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Add ``line_text``: the trimmed source line of each finding; null if blank, missing or without ``lines`` (path, line, text)."""
    if lines is None:
        return findings.withColumn("line_text", F.lit(None).cast("string"))
    of = lines.select(F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.nullif(F.trim("text"), F.lit("")).alias("line_text"))
    return findings.join(of.dropDuplicates(["file_path", "line_number"]), ["file_path", "line_number"], "left")


def _related(findings: DataFrame, each) -> Column:
    """The related places by ``each``, null where there are none."""
    if "related" not in findings.columns:
        return F.lit(None).cast("string")
    return F.when(F.size("related") > 0, F.transform("related", each))


def json_finding(findings: DataFrame) -> Column:
    """A finding as JSON, null fields left out."""
    line_text = F.col("line_text") if "line_text" in findings.columns else F.lit(None).cast("string")
    place = lambda r: F.struct(r["file_path"].alias("filePath"), r["line_number"].alias("lineNumber"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), "title", "message", tier_name(F.col("certainty")).alias("certainty"), category_name(F.col("category")).alias("category"), F.col("file_path").alias("filePath"),
            F.col("line_number").alias("lineNumber"), F.col("character_offset").alias("characterOffset"), line_text.alias("lineText"), _related(findings, place).alias("relatedLocations"),
        )
    )


def _document(findings: DataFrame, item: Column, head: DataFrame, tail: str) -> DataFrame:
    """(json): a document's lines: head (json), the findings in report order, tail. A line for each finding, so no row holds the whole report."""
    order = [c for c in ORDER if c in findings.columns]
    lines = number_rows(findings.select(item.alias("j"), *order), order, "pos").select("pos", "j")
    body = lines.select("pos", F.concat(F.when(F.col("pos") > 1, F.lit(",")).otherwise(F.lit("")), "j").alias("json"))
    opened = head.select(F.lit(0).cast("bigint").alias("pos"), "json")
    closed = findings.sparkSession.range(1).select(F.lit(LAST).alias("pos"), F.lit(tail).alias("json"))
    return opened.unionByName(body).unionByName(closed).orderBy("pos").select("json")


def json_report(findings: DataFrame, tool_version: str, commit_sha: str | None, generated_at_utc: str, suppression: dict | None = None, entropy_rate: dict | None = None) -> DataFrame:
    """(json): the report as lines; joined by line breaks they are one JSON document. Sections that weren't asked for are left out."""
    head = {k: v for k, v in (("toolVersion", tool_version), ("commitSha", commit_sha), ("generatedAtUtc", generated_at_utc)) if v is not None}
    tail = "]" + "".join(f',"{k}":{json.dumps(v)}' for k, v in (("suppression", suppression), ("entropyRate", entropy_rate)) if v is not None) + "}"
    opened = findings.sparkSession.range(1).select(F.lit(json.dumps(head, separators=(",", ":"))[:-1] + ',"findings":[').alias("json"))
    return _document(findings, json_finding(findings), opened, tail)


def sarif_level(certainty: Column) -> Column:
    return F.when(certainty == 1, "error").when(certainty.isin(2, 3), "warning").otherwise("note")


def sarif_rules(findings: DataFrame, order: str | Column) -> DataFrame:
    """(id, name): a row for each rule, named by its first title."""
    return findings.groupBy(F.col("rule_id").alias("id")).agg(F.min_by("title", order).alias("name"))


def file_uri(path: Column) -> Column:
    """An absolute path as a file URI."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    slashed = F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))
    safe = F.transform(F.split(slashed, "/"), lambda s: F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":")))
    return F.concat(F.lit("file://"), F.array_join(safe, "/"))


def sarif_result(findings: DataFrame) -> Column:
    """A finding as a SARIF result; the tier and the category are kept as properties."""
    line_text = F.col("line_text") if "line_text" in findings.columns else F.lit(None).cast("string")
    at = lambda path: F.struct(file_uri(path).alias("uri")).alias("artifactLocation")
    snippet = F.when(line_text.isNotNull(), F.struct(line_text.alias("text"))).alias("snippet")
    region = F.struct(F.col("line_number").alias("startLine"), F.col("character_offset").alias("startColumn"), snippet).alias("region")
    other = lambda r: F.struct(at(r["file_path"]), F.struct(r["line_number"].alias("startLine"), F.lit(1).alias("startColumn")).alias("region"))
    location = F.struct(F.struct(at(F.col("file_path")), region).alias("physicalLocation"), _related(findings, other).alias("relatedLocations"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), sarif_level(F.col("certainty")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"),
            F.struct(tier_name(F.col("certainty")).alias("certainty"), category_name(F.col("category")).alias("category")).alias("properties"),
        )
    )


def sarif_report(findings: DataFrame, tool_version: str, name: str = "lodeworks", information_uri: str | None = None) -> DataFrame:
    """(json): a SARIF log as lines: schema, version, one run with its driver, rules by id, results in report order."""
    first = F.struct(*(c for c in ORDER if c in findings.columns))
    rule = F.struct("id", "name", F.struct(F.col("name").alias("text")).alias("shortDescription"))
    rules = sarif_rules(findings.withColumn("order_", first), "order_").agg(F.to_json(F.sort_array(F.collect_list(rule))).alias("rules"))  # as many as there are rules
    log = json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION}, separators=(",", ":"))[:-1]
    driver = json.dumps({k: v for k, v in (("name", name), ("version", tool_version), ("informationUri", information_uri)) if v is not None}, separators=(",", ":"))[:-1]
    head = rules.select(F.concat(F.lit(f'{log},"runs":[{{"tool":{{"driver":{driver},"rules":'), "rules", F.lit('}},"results":[')).alias("json"))
    return _document(findings, sarif_result(findings), head, "]}]}")


def write_lines(lines: DataFrame, path: str) -> None:
    """A report's lines into one folder, parts in order."""
    lines.write.mode("overwrite").text(path)


def console(findings: DataFrame, rows: int = 200) -> None:
    """The first findings in report order, and how many there are."""
    ordered = findings.orderBy(*[c for c in ORDER if c in findings.columns])
    ordered.select(tier_name(F.col("certainty")).alias("tier"), "rule_id", "file_path", "line_number", "message").show(rows, truncate=120)
    total = findings.count()
    print(f"{total} finding(s)" + (f", the first {rows} shown" if total > rows else ""))


def console_audit(audit: dict) -> None:
    """The suppression audit: its totals, a line for each suppression, and those without use."""
    t = audit["totals"]
    print(f"Suppressions: {t['findingsDropped']} of {t['findingsAnalysed']} finding(s) dropped, {t['findingsHiddenByShadow']} hidden before analysis, {t['hiddenDebtPercent']} % of all hidden")
    for section in ("pathGlobs", "severityOverrides", "disabledRules", "namespaceExclusions"):
        for e in audit[section]:
            print(f"  {e['channel']:<20} {e['selector']:<40} {e['suppressedCount']:>6} {e['downgradedCount']:>6}  {', '.join(e['ruleIds'])} {e['detail']}".rstrip())
    for o in audit["obsolete"]:
        print(f"  obsolete: {o['channel']} {o['selector']} ({o['confidence']}): {o['reason']}")


def console_entropy(report: dict) -> None:
    """The entropy rate and the months of its ledger."""
    rate = report.get("findingsPerKloc")
    print(f"Entropy: {report['status']}, {report['newFindings']} new, {report['resolvedFindings']} resolved, rate {'-' if rate is None else f'{rate:.2f}'}")
    for m in report["monthly"]:
        print(f"  {m['month']}  new {m['newFindings']:>5}  resolved {m['resolvedFindings']:>5}  lines {m['linesChanged']:>8}  rate {'-' if m.get('findingsPerKloc') is None else format(m['findingsPerKloc'], '.2f')}")
