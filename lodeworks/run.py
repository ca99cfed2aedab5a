"""One analysis run, from facts to report: options, configuration, baseline, entropy, exit code."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import rules
from lodeworks.operators import audit, clones, entropy, findings
from lodeworks.rules import shapes
from lodeworks.session import build_session
from lodeworks.sinks import reports
from lodeworks.sinks.reports import Exit, exit_code, write_lines
from lodeworks.sources.facts import Facts
from lodeworks.sources.projects import read_stored
from lodeworks.sources.shared import stage

VERSION = "0.1.0"


@dataclass
class Options:
    target: str
    output: str | None = None
    format: str = "json"
    certainty_tier: str = "advisory"
    exclude_namespaces: list[str] = field(default_factory=list)
    audit_suppressions: bool = False
    config_analysis: bool = False
    duplicate_detection: bool = False
    clone_drift: bool = False
    max_complexity: int = 15
    max_cognitive_complexity: int = 15
    baseline: str | None = None
    entropy_rate: bool = False
    entropy_budget: float | None = None
    entropy_ledger: str | None = None
    entropy_min_lines: int = entropy.DEFAULT_MIN_LINES

    def __post_init__(self) -> None:
        self.duplicate_detection |= self.clone_drift
        self.entropy_rate |= self.entropy_budget is not None or self.entropy_ledger is not None
        if self.entropy_rate and not self.baseline:
            raise ValueError("an entropy rate needs a baseline")
        if self.certainty_tier.lower() not in findings.TIERS:
            raise ValueError(f"unknown tier {self.certainty_tier}")
        if self.format not in ("json", "sarif"):
            raise ValueError(f"unknown format {self.format}")
        if min(self.max_complexity, self.max_cognitive_complexity) < 1 or (self.entropy_budget or 0) < 0:
            raise ValueError("limits are 1 or more, a budget 0 or more")
        for ns in self.exclude_namespaces:
            if ns != "<global>" and not all(p.isidentifier() for p in ns.split(".")):
                raise ValueError(f"no namespace: {ns}")

    @property
    def opted(self) -> set[str]:
        return {o for o in ("config_analysis", "duplicate_detection", "clone_drift") if getattr(self, o)}


def parse(argv: list[str]) -> Options:
    p = argparse.ArgumentParser(prog="lodeworks")
    p.add_argument("--version", "-v", action="version", version=VERSION)
    p.add_argument("target")
    p.add_argument("output", nargs="?")
    p.add_argument("--format", default="json")
    p.add_argument("--certainty-tier", default="advisory")
    p.add_argument("--exclude-namespaces", action="append", default=[])
    for flag in ("audit-suppressions", "config-analysis", "duplicate-detection", "clone-drift", "entropy-rate"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--max-complexity", type=int, default=15)
    p.add_argument("--max-cognitive-complexity", type=int, default=15)
    p.add_argument("--baseline")
    p.add_argument("--entropy-budget", type=float)
    p.add_argument("--entropy-ledger")
    p.add_argument("--entropy-min-lines", type=int, default=entropy.DEFAULT_MIN_LINES)
    args = vars(p.parse_args(argv))
    args["exclude_namespaces"] = [n.strip() for x in args["exclude_namespaces"] for n in x.split(",") if n.strip()]
    return Options(**args)


def config_of(text: str | None, warn=print) -> findings.Config:
    """A configuration from its JSON; another version or bad JSON gives the defaults and a warning, unknown tiers are left out."""
    if not text:
        return findings.Config()
    try:
        data = json.loads(text)
    except ValueError as e:
        warn(f"configuration is no JSON: {e}")
        return findings.Config()
    if data.get("version", 1) != 1:
        warn(f"configuration version {data.get('version')} is not known")
        return findings.Config()
    kept = {}
    for rule, state in (data.get("rules") or {}).items():
        if str(state).lower() in (*findings.TIERS, "off"):
            kept[rule] = str(state)
        else:
            warn(f"unknown state {state} of {rule}")
    excluded = data.get("exclude") or {}
    return findings.Config(kept, tuple(excluded.get("paths") or ()), tuple(excluded.get("namespaces") or ()))


def find_config(folders: dict[str, str], start: str) -> str | None:
    """The configuration text of the nearest folder at or above ``start``."""
    here = PurePosixPath(start)
    return next((folders[str(f)] for f in (here, *here.parents) if str(f) in folders), None)


@dataclass
class Outcome:
    report: DataFrame
    exit: Exit
    reported: DataFrame
    entropy: DataFrame | None = None
    months: DataFrame | None = None
    audit: dict | None = None
    entropy_report: dict | None = None
    warnings: tuple[str, ...] = ()


def needs_lifted(options: Options, config: findings.Config) -> bool:
    """Whether the baseline needs a pass without suppressions: it would change with them else."""
    return options.baseline is not None and bool(options.exclude_namespaces or config.namespaces or config.off)


def _entropy_report(one, budget: float | None, minimum: int, months: DataFrame | None) -> dict:
    """The report's section, null fields left out."""
    status = "".join(w.capitalize() for w in one.status.split("_"))
    monthly = [] if months is None else [{"month": m.month, "newFindings": m.new_findings, "resolvedFindings": m.resolved_findings, "linesChanged": m.lines_changed} | ({} if m.rate is None else {"findingsPerKloc": m.rate}) for m in months.orderBy("month").collect()]
    fields = {
        "status": status, "scored": one.status == "scored", "newFindings": one.new_findings, "resolvedFindings": one.resolved_findings, "linesChanged": one.lines, "baselineCommitSha": one.baseline_sha,
        "headCommitSha": one.head_sha, "minimumLines": max(minimum, 1), "findingsPerKloc": one.rate, "budget": budget, "budgetExceeded": bool(one.exceeds), "monthly": monthly,
    }
    return {k: v for k, v in fields.items() if v is not None}


def run(spark: SparkSession, facts: Facts, options: Options, config: findings.Config = findings.Config(), context: dict | None = None, generated_at_utc: str = "1970-01-01T00:00:00Z") -> Outcome:
    """Rules, exclusion, classification, baseline, audit, entropy and report.

    context: head_sha, baseline_sha, is_git, dirty of the run. All rules run once, their findings are written, and each pass is a part
    of that table: what is shown (rules that are on, namespaces that aren't excluded), what rules that are off would say, and what only
    shows without exclusions. The baseline takes the whole table, so suppressions don't change it; where one is given, the report
    holds findings that it doesn't know. Its fingerprints are collected before the file is written; months are of the ledger before this run.
    """
    everything = rules.analyse(facts, options.opted, limits={"R0033": options.max_complexity, "R0034": options.max_cognitive_complexity})
    excluded = [*options.exclude_namespaces, *config.namespaces]
    spaces = facts["documents"].select(F.col("path").alias("file_path"), "namespace").dropDuplicates(["file_path"])
    print_of = findings.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message"), options.target)
    marked = everything.join(spaces, "file_path", "left").withColumns(
        {"off": F.lower("rule_id").isin(config.off) if config.off else F.lit(False), "excluded": findings.namespace_covered(F.col("namespace"), excluded), "fingerprint": print_of}
    )
    marked = stage(marked.select(*everything.columns, "off", "excluded", "fingerprint"), "findings", gather=True)
    warnings = []
    if options.duplicate_detection:
        over_cap = shapes.dropped_windows(facts).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("places") - clones.CAP), F.lit(0)).alias("places")).first()
        if over_cap.n:
            warnings.append(f"{over_cap.n} window(s) occur more than {clones.CAP} times; {over_cap.places} place(s) of them were not compared")
    shown = marked.where("not off and not excluded")
    disabled, hidden = marked.where("off and not excluded"), marked.where("excluded")
    audited = None
    if options.audit_suppressions:
        accounted = marked.where("not excluded").select("fingerprint").distinct()
        shadow = hidden.where("not off").join(accounted, "fingerprint", "left_anti") if excluded else None
        files, names = facts["documents"].select("path"), facts["documents"].select(F.col("namespace").alias("ns")).distinct()
        known = facts.has("documents")
        audited = audit.build(shown, config, options.certainty_tier, disabled if config.off else None, shadow, files if known else None, names if known else None)
    visible, over, state, months, section = shown, False, None, None, None
    if options.baseline:
        source = marked if needs_lifted(options, config) else shown
        current = source.select("fingerprint").distinct()
        known = stage(read_stored(spark, options.baseline, "fingerprint string"), "baseline")
        visible = shown.join(known, "fingerprint", "left_anti")
        if options.entropy_rate:
            c = {"head_sha": None, "baseline_sha": None, "is_git": True, "dirty": False} | (context or {})
            lines = entropy.changed_lines(facts["numstat"], list(config.paths)) if facts.has("numstat") else spark.sql("SELECT cast(null as bigint) AS lines")
            row = lines.withColumns({k: F.lit(v).cast("string" if k.endswith("sha") else "boolean") for k, v in c.items()} | {"baseline_existed": F.lit(not known.isEmpty())})
            new, resolved = visible.count(), findings.against_baseline(current, known)["resolved"].count()
            row = row.withColumns({"new_findings": F.lit(new).cast("bigint"), "resolved_findings": F.lit(resolved).cast("bigint"), "status": entropy.status(options.entropy_min_lines)})
            value = entropy.rate(F.col("new_findings"), F.col("lines"), F.col("status"))
            state = row.withColumns({"rate": value, "exceeds": entropy.exceeds(value, F.col("status"), options.entropy_budget)})
            one = state.first()
            over = bool(one.exceeds)
            if options.entropy_ledger:
                schema = "commit_sha string, recorded_at_utc string, new_findings bigint, resolved_findings bigint, lines_changed bigint"
                ledger = stage(read_stored(spark, options.entropy_ledger, schema), "ledger")
                months = stage(entropy.monthly(ledger), "months")
                if one.status == "scored":
                    entry = spark.createDataFrame([(one.head_sha, generated_at_utc, one.new_findings, one.resolved_findings, one.lines)], schema)
                    entropy.upsert(ledger, entry).coalesce(1).write.mode("overwrite").json(options.entropy_ledger)
            section = _entropy_report(one, options.entropy_budget, options.entropy_min_lines, months)
        findings.baseline(current).coalesce(1).write.mode("overwrite").json(options.baseline)
    reported = findings.tier_floor(findings.apply(visible.select(everything.columns), config), options.certainty_tier)
    with_text = reports.with_line_text(reported, facts["lines"] if facts.has("lines") else None)
    if options.format == "json":
        report = reports.json_report(with_text, VERSION, (context or {}).get("head_sha"), generated_at_utc, audited, section)
    else:
        report = reports.sarif_report(with_text, VERSION)
    written = True
    if options.output:
        try:
            write_lines(report, options.output)
        except Exception as e:  # noqa: BLE001  any failed write is exit code 2
            print(f"report not written: {e}")
            written = False
    return Outcome(report, exit_code(True, written, over), reported, state, months, audited, section, tuple(warnings))


def git(folder: str, *args: str) -> str | None:
    """What a git command prints; None where it fails or git isn't there."""
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_context(folder: str, baseline_sha: str | None = None) -> dict:
    """head_sha, is_git, dirty and baseline_sha of a run on ``folder``."""
    head, changes = git(folder, "rev-parse", "HEAD"), git(folder, "status", "--porcelain")
    return {"head_sha": head.strip() if head else None, "is_git": head is not None, "dirty": bool(changes and changes.strip()), "baseline_sha": baseline_sha}


def config_near(start: str, name: str = "lodeworks.json") -> str | None:
    """The text of the nearest file ``name`` at or above ``start``; the nearest one wins, nothing is merged."""
    here = Path(start).absolute()
    for folder in (here, *here.parents):
        try:
            return (folder / name).read_text(encoding="utf-8-sig")
        except OSError:
            continue
    return None


def main(argv: list[str] | None = None) -> int:
    """``lodeworks FACTS [OUTPUT] [options]``: a run on a folder of fact tables, shown on the console; its exit code.

    With LODEWORKS_PERF set, a line of timings goes to standard error.
    """
    began = time.perf_counter()
    try:
        options = parse(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return Exit.USAGE
    spark = build_session("lodeworks")
    try:
        facts = Facts(spark, options.target)
        if not facts.any():
            print(f"error: no fact tables in {options.target}", file=sys.stderr)
            return Exit.USAGE
        loaded = time.perf_counter()
        config = config_of(config_near(options.target), lambda w: print(f"warning: {w}", file=sys.stderr))
        done = run(spark, facts, options, config, git_context(options.target), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    except AnalysisException as e:
        print(f"error: {e}", file=sys.stderr)
        return Exit.USAGE
    for w in done.warnings:
        print(f"warning: {w}", file=sys.stderr)
    reports.console(done.reported)
    if done.audit:
        reports.console_audit(done.audit)
    if done.entropy_report:
        reports.console_entropy(done.entropy_report)
    if os.environ.get("LODEWORKS_PERF"):
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
        print(f"perf load={loaded - began:.2f}s run={time.perf_counter() - loaded:.2f}s jobs={jobs}", file=sys.stderr)
    return int(done.exit)


if __name__ == "__main__":
    sys.exit(main())
