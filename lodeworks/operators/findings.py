"""Findings: fingerprint, exclusion, classification, tiers, baseline, order, audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import first_glob, namespace_covered

TIERS = {"guaranteed": 1, "high": 2, "moderate": 3, "advisory": 4}
TIER_NAMES = {v: k for k, v in TIERS.items()}
ORDER = ["certainty", "file_path", "line_number", "character_offset", "rule_id", "message", "category", "title"]


@dataclass(frozen=True)
class Config:
    """Suppressions: rules off or moved to a tier, path globs in order, namespaces."""

    rules: dict[str, str] = field(default_factory=dict)  # rule id -> off or a tier's name, ids case-blind
    paths: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()

    @property
    def off(self) -> list[str]:
        return sorted(k.lower() for k, v in self.rules.items() if v.lower() == "off")

    @property
    def overrides(self) -> dict[str, int]:
        return {k.lower(): TIERS[v.lower()] for k, v in self.rules.items() if v.lower() != "off"}


def fingerprint(rule_id: Column, file_path: Column, message: Column, root: str = "") -> Column:
    """SHA-256 of rule, path from the root with forward slashes, and message; line numbers are left out."""
    path = F.replace(file_path, F.lit("\\"), F.lit("/"))
    root = root.replace("\\", "/").rstrip("/") + "/" if root else ""
    if root:
        path = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    return F.sha2(F.concat_ws("|", rule_id, path, message), 256)


def classify(findings: DataFrame, config: Config) -> DataFrame:
    """Add outcome (disabled, path, override, kept), matched_glob and new_certainty; the first that fits wins."""
    rule = F.lower("rule_id")
    glob = first_glob(F.col("file_path"), list(config.paths))
    tier = F.lit(None).cast("int")
    for name, value in config.overrides.items():
        tier = F.when(rule == name, value).otherwise(tier)
    off = rule.isin(config.off) if config.off else F.lit(False)
    out = findings.withColumns({"_glob": glob, "_tier": tier, "_off": off})
    outcome = F.when(F.col("_off"), "disabled").when(F.col("_glob").isNotNull(), "path").when(F.col("_tier").isNotNull(), "override").otherwise("kept")
    out = out.withColumn("outcome", outcome)
    return out.withColumns({"matched_glob": F.when(F.col("outcome") == "path", F.col("_glob")), "new_certainty": F.when(F.col("outcome") == "override", F.col("_tier")).otherwise(F.col("certainty").cast("int"))}).drop("_glob", "_tier", "_off")


def apply(findings: DataFrame, config: Config) -> DataFrame:
    """What stays, with certainty rewritten; the same decision as :func:`classify`."""
    return classify(findings, config).where(F.col("outcome").isin("override", "kept")).withColumn("certainty", F.col("new_certainty")).select(findings.columns)


def tier_floor(findings: DataFrame, tier: str) -> DataFrame:
    """Findings at least as certain as the tier (1 is the strongest)."""
    return findings.where(F.col("certainty") <= TIERS[tier.lower()])


def visible(findings: DataFrame, namespace: Column, excluded: list[str]) -> DataFrame:
    return findings.where(~namespace_covered(namespace, excluded))


def report_order(findings: DataFrame) -> DataFrame:
    """Sorted by the report's total order."""
    return findings.orderBy(*[c for c in ORDER if c in findings.columns])


def against_baseline(current: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Fingerprint sets: new, known (suppressed), resolved. Both sides hold a column ``fingerprint``."""
    now, then = current.select("fingerprint").distinct(), known.select("fingerprint").distinct()
    return {"new": now.join(then, "fingerprint", "left_anti"), "known": now.join(then, "fingerprint", "left_semi"), "resolved": then.join(now, "fingerprint", "left_anti")}


def baseline(current: DataFrame) -> DataFrame:
    """The baseline to store: distinct fingerprints in order."""
    return current.select("fingerprint").distinct().orderBy("fingerprint")


def preferred(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def audit_entries(findings: DataFrame, config: Config, floor: str = "advisory") -> DataFrame:
    """(channel, selector, findings, rules): what each suppression hides or moves; selectors without effect have 0.

    A finding that an override pushes past the floor is put down to the override.
    """
    spark = findings.sparkSession
    classed = classify(findings, config)
    limit = TIERS[floor]
    hit = classed.select(
        F.when(F.col("outcome") == "disabled", "rule").when(F.col("outcome") == "path", "path").when(F.col("outcome") == "override", "override").when(F.col("certainty") > limit, "tier").alias("channel"),
        F.when(F.col("outcome") == "path", F.col("matched_glob")).when(F.col("outcome").isin("disabled", "override"), F.lower("rule_id")).otherwise(F.lit(floor)).alias("selector"),
        "rule_id",
    ).where("channel is not null")
    tally = hit.groupBy("channel", "selector").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    known = [("rule", r) for r in config.off] + [("override", r) for r in config.overrides] + [("path", g) for g in config.paths] + [("tier", floor)]
    selectors = spark.sql("VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in known)).toDF("channel", "selector")
    return selectors.join(tally, ["channel", "selector"], "left").select("channel", "selector", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"), F.coalesce("rules", F.lit("")).alias("rules"))


def audit_totals(findings: DataFrame, config: Config, floor: str = "advisory", shadowed: int = 0) -> DataFrame:
    """One row: analysed, dropped, downgraded, visible, hidden_debt_percent (half away from zero; 0 of nothing)."""
    limit = TIERS[floor]
    c = classify(findings, config)
    gone = F.col("outcome").isin("disabled", "path") | (F.col("new_certainty") > limit)
    t = c.agg(F.count("*").alias("analysed"), F.count_if(gone).alias("dropped"), F.count_if((F.col("outcome") == "override") & ~gone & (F.col("new_certainty") > F.col("certainty"))).alias("downgraded"))
    base = F.col("analysed") + F.lit(shadowed)
    return t.select("analysed", "dropped", "downgraded", (F.col("analysed") - F.col("dropped")).alias("visible"), F.when(base == 0, F.lit(0)).otherwise(F.round(F.lit(100.0) * (F.col("dropped") + F.lit(shadowed)) / base).cast("bigint")).alias("hidden_debt_percent"))


def obsolete(findings: DataFrame, config: Config, files: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(channel, selector, confidence): suppressions without use. files: (path); namespaces: (ns)."""
    spark = findings.sparkSession
    local = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    entries = audit_entries(findings, config).where("findings = 0 and channel in ('rule', 'override')").select("channel", "selector", F.lit("suspected").alias("confidence"))
    if config.paths:
        hits = files.agg(*(F.coalesce(F.bool_or(first_glob(F.col("path"), [g]).isNotNull()), F.lit(False)).alias(str(i)) for i, g in enumerate(config.paths)))
        some = hits.select(F.inline(F.array(*(F.struct(F.lit(g).alias("selector"), F.col(str(i)).alias("used")) for i, g in enumerate(config.paths)))))
        entries = entries.union(some.where("not used").select(F.lit("path"), "selector", F.lit("certain")))
    if config.namespaces:
        from lodeworks.functions.text import namespace_prefixes

        declared = namespaces.select(F.explode(namespace_prefixes(F.col("ns"))).alias("selector")).distinct()
        unused = local(config.namespaces, "selector").join(declared, "selector", "left_anti")
        entries = entries.union(unused.select(F.lit("namespace"), "selector", F.lit("certain")))
    return entries


def namespace_shadow(lifted: DataFrame, shown: DataFrame, disabled: DataFrame) -> DataFrame:
    """Fingerprints that only the pass without namespace exclusions has."""
    return lifted.select("fingerprint").distinct().join(shown.select("fingerprint").union(disabled.select("fingerprint")), "fingerprint", "left_anti")
