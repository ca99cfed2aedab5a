"""The suppression audit: what a configuration hides, moves, and names in vain.

Findings are tallied where they are; what comes to the driver is a row for each suppression and rule, bounded by the configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import first_glob, namespace_prefixes
from lodeworks.operators.findings import TIERS, Config, classify

CHANNELS = ("PathGlob", "SeverityOverride", "DisabledRule", "NamespaceExclusion", "CertaintyTier")


def _name(tier: int) -> str:
    return next(k.capitalize() for k, v in TIERS.items() if v == tier)


def _entry(channel: str, selector: str, hidden: int = 0, moved: int = 0, rules=(), detail: str = "") -> dict:
    return {"channel": channel, "selector": selector, "suppressedCount": hidden, "downgradedCount": moved, "ruleIds": sorted(set(rules)), "detail": detail}


def unused_globs(globs: tuple[str, ...], files: DataFrame | None) -> list[str]:
    """Globs that match no file of ``files`` (path); none where there are no files to ask."""
    if not globs or files is None:
        return []
    hits = files.agg(F.count("*").alias("n"), *(F.coalesce(F.bool_or(first_glob(F.col("path"), [g]).isNotNull()), F.lit(False)).alias(f"g{i}") for i, g in enumerate(globs))).first()
    return [g for i, g in enumerate(globs) if hits.n and not hits[f"g{i}"]]


def undeclared(excluded: tuple[str, ...], namespaces: DataFrame | None) -> list[str]:
    """Namespaces that are neither declared nor around a declared one. namespaces: (ns)."""
    if not excluded or namespaces is None:
        return []
    declared = namespaces.select(F.explode(namespace_prefixes(F.col("ns"))).alias("ns")).where(F.col("ns").isin(*excluded)).distinct()
    there = {r.ns for r in declared.collect()}  # at most as many as are excluded
    return sorted(n for n in set(excluded) if n not in there)


def build(analysed: DataFrame, config: Config, floor: str | None = None, disabled: DataFrame | None = None, shadow: DataFrame | None = None, files: DataFrame | None = None, namespaces: DataFrame | None = None) -> dict:
    """The audit as the report shows it.

    analysed: findings of the rules that are on, before any filter. disabled, shadow: findings of rules that are off, and those that only
    show with namespace exclusions lifted; given where those passes ran. A finding that an override pushes past the floor is put
    down to the override.
    """
    ran = disabled is not None or shadow is not None
    limit = TIERS[floor.lower()] if floor else max(TIERS.values())
    c = classify(analysed, config).withColumn("past", F.col("new_certainty") > limit)
    kind = F.when(F.col("outcome") == "disabled", "rule").when(F.col("outcome") == "path", "path")
    kind = kind.when(F.col("past") & (F.col("outcome") == "override") & (F.col("certainty") <= limit), "pushed").when(F.col("past"), "tier")
    rows = c.groupBy(kind.alias("kind"), "outcome", "matched_glob", "rule_id", "certainty").agg(F.count("*").alias("n")).collect()  # rules x tiers x globs
    off = {r.rule_id: r.n for r in disabled.groupBy("rule_id").agg(F.count("*").alias("n")).collect()} if disabled is not None else {}
    shadowed = shadow.count() if shadow is not None else 0
    total, dropped = sum(r.n for r in rows), sum(r.n for r in rows if r.kind)
    hidden_before = sum(off.values()) + shadowed
    downgraded = sum(r.n for r in rows if r.outcome == "override" and not r.kind)
    base = total + hidden_before
    names = {state: sorted(k for k, v in config.rules.items() if (v.lower() == "off") == (state == "off")) for state in ("off", "moved")}
    of = lambda rule, r: r.rule_id.lower() == rule.lower()

    globs = [_entry("PathGlob", g, sum(r.n for r in rows if r.kind == "path" and r.matched_glob == g), rules=[r.rule_id for r in rows if r.kind == "path" and r.matched_glob == g]) for g in config.paths]
    moved = []
    for rule in names["moved"]:
        mine = [r for r in rows if of(rule, r)]
        seen: dict[int, int] = {}
        for r in mine:
            seen[r.certainty] = seen.get(r.certainty, 0) + r.n
        was = ", ".join(f"{_name(k)}x{seen[k]}" for k in sorted(seen))
        there = [r for r in mine if r.outcome == "override"]
        moved.append(_entry("SeverityOverride", rule, sum(r.n for r in there if r.kind == "pushed"), sum(r.n for r in there), [r.rule_id for r in there], f"-> {config.rules[rule].capitalize()} (was {was})"))
    dead = []
    for rule in names["off"]:
        count = sum(r.n for r in rows if r.kind == "rule" and of(rule, r)) + sum(n for k, n in off.items() if k.lower() == rule.lower())
        dead.append(_entry("DisabledRule", rule, count, rules=[rule] if count else []))
    spaces = []
    if config.namespaces:
        why = f"aggregate over {len(set(config.namespaces))} namespace(s)" if shadow is not None else "not measured: no pass without exclusions"
        spaces = [_entry("NamespaceExclusion", ", ".join(sorted(set(config.namespaces))), shadowed, detail=why)]
    tier = [r for r in rows if r.kind == "tier"]
    obsolete = [("PathGlob", g, "Certain", "matches no file") for g in unused_globs(config.paths, files)]
    obsolete += [("SeverityOverride", e["selector"], "Suspected", "no finding was moved") for e in moved if not e["downgradedCount"]]
    obsolete += [("DisabledRule", e["selector"], "Suspected", "no findings when run" if ran else "no findings; not run while off") for e in dead if not e["suppressedCount"]]
    obsolete += [("NamespaceExclusion", n, "Certain", "declared nowhere") for n in undeclared(config.namespaces, namespaces)]
    obsolete.sort(key=lambda o: (CHANNELS.index(o[0]), o[1]))
    return {
        "totals": {
            "findingsAnalysed": total, "findingsHiddenByShadow": hidden_before, "findingsDropped": dropped, "findingsDowngraded": downgraded, "findingsAfterSuppression": total - dropped,
            "hiddenDebtPercent": int(100 * (dropped + hidden_before) / base + 0.5) if base else 0,
        },
        "pathGlobs": globs, "severityOverrides": moved, "disabledRules": dead, "namespaceExclusions": spaces,
        **({"certaintyFilter": _entry("CertaintyTier", floor.capitalize(), sum(r.n for r in tier), rules=[r.rule_id for r in tier])} if floor and tier else {}),
        "obsolete": [dict(zip(("channel", "selector", "confidence", "reason"), o, strict=True)) for o in obsolete],
        "shadowAnalysisRan": ran,
    }
