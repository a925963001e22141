"""Command line: ``python -m codestrata.cli COMMAND``; output is text, or complete JSON with ``--json`` (P, A12, A15).

Limits (``--top``) cut what is displayed, never what JSON holds.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .config import Config, load_config, load_limits, load_policy
from .extract import rules
from .operators import evidence, ranking, reviews
from .plans.calibration import calibrate
from .plans.evaluation import evaluate
from .plans.review import review_targets
from .plans.snapshot import Profile
from .session import build_session, ship
from .sources.reports import append_event, as_report, events_table, load_ledger, load_profile, to_json

EXPERIMENTS = {"errors": "handlers", "models": "models", "variants": "variants", "derived": "derived"}


#: A line of text for each row of a table; tables that are not here are shown column by column.
LINES = {
    "scores": "{language}/{cohort}: {points} {band} ({sloc} source lines, {reason})",
    "contributions": "{language}/{cohort} {metric_id}: {points} of percentile {percentile}, raw {raw}",
    "metrics": "{language}/{cohort} {metric_id}: {state} {value} {reason}",
    "coverage": "{state} {language}/{cohort}: {file_count} files, {sloc} source lines ({reason})",
    "diagnostics": "{path}:{start_line}: {severity} {code}: {message}",
    "hotspots": "{points} {path} ({band})",
    "directories": "{directory}/ {files} files",
    "patterns": "{path}:{start_line}-{end_line}: {severity} {rule_id}: {message}",
    "functions": "{path}:{start_line}-{end_line}: {qualified_name}: complexity {complexity}",
    "findings": "{state}: {n}",
    "errors": "{path}:{start_line}: {symbol}: {state} {fallback_kind} {reason}",
    "models": "{path}:{start_line}: {model}: {state} {guard} {consumers} {reason}",
    "variants": "{path}:{start_line}: {symbol}: {state} {outcome} {missing} {reason}",
    "derived": "{path}:{start_line}: {symbol}: {state} {derived} of {source} after {operation} {reason}",
    "symbols": "{state}: {old_occ} -> {new_occ} {reason}",
    "cycles": "{module} in the cycle of {cycle}",
    "fan_out": "{module} imports {fan_out}",
    "violations": "{importer} must not import {imported}",
    "commits": "{step} {revision} {boundary}",
    "rework": "{path}:{line}: {state} {age_seconds} s {reason}",
    "budget": "{metric}: {observed} of {maximum}: {state}",
    "reviews": "{review_id}: {disposition}, {state} {causes}",
    "targets": "{review_id}: {symbol} in {paths} {unavailable}",
    "rules": "{rule_id} ({category}, {severity}): {message}",
}


def _text(title: str, df: DataFrame, top: int) -> str:
    rows = df.limit(top + 1).collect()
    fields = {f for _, f, _, _ in Formatter().parse(LINES.get(title, "")) if f}
    if title in LINES and fields <= {*df.columns}:
        shown = [LINES[title].format_map({k: "-" if v is None else v for k, v in r.asDict().items()}) for r in rows[:top]]
        return "\n".join([title, *(f"  {x}" for x in shown), *(["  ..."] if len(rows) > top else [])])
    lines = [title, "  " + " | ".join(df.columns)]
    lines += ["  " + " | ".join("-" if v is None else str(v) for v in r) for r in rows[:top]]
    return "\n".join([*lines, *(["  ..."] if len(rows) > top else [])])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata")
    p.add_argument("command", choices=["score", "scan", "tree", "explain", "findings", "rules", "compare", "changes", "surface", "architecture", "history", "errors", "models", "variants", "derived", "review-set", "review-list", "review-show", "review-legacy", "calibrate", "evaluate"])
    p.add_argument("--root", default=".")
    p.add_argument("--revision", help="a commit instead of the directory")
    p.add_argument("--before", help="commit of the baseline")
    p.add_argument("--before-root", help="directory of the baseline")
    p.add_argument("--config", type=Path)
    p.add_argument("--tool-name", default="codestrata", help="table and file name of the settings")
    p.add_argument("--lang", action="append", default=None)
    p.add_argument("--strict", action="store_true", default=None)
    p.add_argument("--path")
    p.add_argument("--metric", choices=sorted(evidence.METRICS))
    p.add_argument("--rule")
    p.add_argument("--severity")
    p.add_argument("--source-root", action="append", default=None)
    p.add_argument("--forbid", action="append", default=[], help="SOURCE:TARGET")
    p.add_argument("--budget", action="append", default=[], help="METRIC=MAXIMUM")
    p.add_argument("--budget-file", type=Path, help="TOML with a table [budget]")
    p.add_argument("--enforce-budget", action="store_true")
    p.add_argument("--policy", type=Path, help="TOML with source_roots and [[forbidden]]")
    p.add_argument("--profiles", type=Path, help="folder of calibration profiles")
    p.add_argument("--manifest", type=Path, help="corpus to calibrate from, or cases to evaluate")
    p.add_argument("--corpus", type=Path, help="folder of the corpus projects, or of the blobs")
    p.add_argument("--kind")
    p.add_argument("--symbol")
    p.add_argument("--cohort")
    p.add_argument("--review-id")
    p.add_argument("--max-commits", type=int, default=20)
    p.add_argument("--start")
    p.add_argument("--ledger", type=Path)
    p.add_argument("--event", help="JSON of a review event")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--json", action="store_true")
    return p


def tables(args: argparse.Namespace) -> dict[str, DataFrame]:
    spark = build_session("codestrata")
    ship(spark)
    config = load_config(Path(args.root), explicit=args.config, tool=args.tool_name, strict=args.strict, languages=tuple(args.lang) if args.lang else None)
    command = args.command
    if command == "rules":
        return {"rules": spark.createDataFrame(rules.catalog(list(config.enabled_rules) or None, list(config.disabled_rules)))}
    if command == "calibrate":
        path = calibrate(spark, args.manifest, args.corpus, args.profiles)
        return {"profile": spark.createDataFrame([(path.stem, str(path))], "profile_id string, path string")}
    if command.startswith("review-"):
        return _reviews(spark, args, config)
    if command == "history":
        return api.analyze_history(spark, args.root, end=args.revision or "HEAD", start=args.start, max_commits=args.max_commits, config=config)
    if command in ("compare", "changes", "surface"):
        first = (args.before_root or args.root, args.before)
        change = api.compare(spark, first[0], first[1], args.revision, other_root=args.root, config=config)
        if command == "surface":
            return {"symbols": change.symbol_changes()}
        if command == "compare":
            return {"loc": change.loc(), "metrics": change.metric_deltas(), "files": change.pairs}
        out = {name: df for name, df in change.review().items()}
        limits = load_limits(args.budget_file) if args.budget_file else {}
        limits |= {k: int(v) for k, _, v in (b.partition("=") for b in args.budget)}
        if limits:
            out["budget"], out["budget_state"] = api.evaluate_budget(change, limits)
        return out
    snap = api.scan(spark, args.root, revision=args.revision, config=config)
    if command == "architecture":
        roots, forbidden = load_policy(args.policy) if args.policy else (["."], [])
        return api._architecture(snap, args.source_root or roots, [*forbidden, *(tuple(f.split(":", 1)) for f in args.forbid)])
    if command in EXPERIMENTS:
        return {command: snap.family(EXPERIMENTS[command])}
    if command == "tree":
        return {"directories": ranking.directories(snap.files).orderBy("directory")}
    if command == "findings":
        members = snap.clone_members.select("group_id", "language", "cohort", "path", "start_line", "end_line")
        return evidence.query_findings(snap.family("findings"), members, snap.family("functions"), path=args.path, metric=args.metric, rule=args.rule, severity=args.severity, threshold=config.complexity_threshold)
    if command == "explain":
        own = F.col("path") == args.path
        row = evidence.only(snap.files.filter(own), args.path)
        return {"file": spark.createDataFrame([row], snap.files.schema), "metrics": snap.metrics(per_file=True).filter(own), "functions": snap.family("functions").filter(own), "findings": snap.family("findings").filter(own)}
    profile, error = _profile(spark, args, config)
    scores, parts = snap.scores(profile, profile_error=error)
    out = {"scores": scores, "contributions": parts, "metrics": snap.metrics()}
    if command == "scan":
        files, _ = snap.scores(profile, per_file=True, profile_error=error)
        out |= {"coverage": snap.coverage, "diagnostics": snap.diagnostics, "files": files, "hotspots": ranking.hotspots(files, config.default_hotspot_count)}
    return out


def _profile(spark: SparkSession, args: argparse.Namespace, config: Config) -> tuple[Profile | None, str | None]:
    """The profile of the settings, or why it could not be loaded."""
    if args.profiles is None or not (args.profiles / f"{config.calibration_profile}.json").exists():
        return None, None
    try:
        return Profile.of(spark, load_profile(args.profiles, config.calibration_profile)), None
    except (ValueError, KeyError, OSError):
        return None, "calibration-invalid"


def _reviews(spark: SparkSession, args: argparse.Namespace, config: Config) -> dict[str, DataFrame]:
    """Decisions of a ledger against the targets of the present state."""
    if args.command == "review-set":
        return {"events": events_table(spark, append_event(args.ledger, json.loads(args.event))).orderBy("sequence")}
    ledger = load_ledger(args.ledger)
    events = events_table(spark, ledger)
    snap = api.scan(spark, args.root, revision=args.revision, config=config)
    if args.command == "review-legacy":
        groups = snap.clone_members.groupBy("group_id", "language", "cohort").agg(F.collect_set("path").alias("paths"))
        decisions = [(d["decision_id"], d.get("group_id"), d.get("language"), d.get("cohort"), d.get("paths", [])) for d in ledger["legacy_decisions"]]
        legacy = spark.createDataFrame(decisions, "decision_id string, group_id string, language string, cohort string, paths array<string>")
        return {"legacy": reviews.legacy_matches(legacy, groups), "superseded": reviews.superseded(events)}
    present = review_targets(snap, (args.kind,) if args.kind else None)
    if args.command == "review-list":
        return {"targets": reviews.select_targets(present, path=args.path, symbol=args.symbol, cohort=args.cohort, review_id=args.review_id).orderBy("review_id")}
    return {"events": events.orderBy("sequence"), "reviews": reviews.resolve(events, present, "snapshot").orderBy("review_id"), "violations": reviews.ledger_violations(events)}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "evaluate":
        code, results = evaluate(args.manifest, args.corpus)
        sys.stdout.write(to_json({"results": results}))
        return code
    try:
        found = tables(args)
        if args.json:
            sys.stdout.write(to_json(as_report(found, command=args.command)))
        else:
            print("\n\n".join(_text(name, df, args.top) for name, df in found.items()))
        if args.enforce_budget and "budget_state" in found and found["budget_state"].first().state != "pass":
            return 1
    except api.StrictFailure as error:
        print(error, file=sys.stderr)
        return 3
    except (ValueError, LookupError, OSError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
