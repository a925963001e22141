"""Evidence queries and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ratios import effective_complexity

FAMILIES = ("patterns", "clones", "functions")
#: Metric name -> evidence families behind it.
METRICS = {"patterns": ("patterns",), "clones": ("clones",), "combined": ("patterns", "clones"), "erosion": ("functions",)}


class LookupFailure(LookupError):
    """A look-up found nothing, or more than one row."""


def complexity_by_version(version: Column, cohort: Column, complexity: Column, assertions: Column) -> Column:
    """Complexity that counts under a definition's version: versions 1 and 2 take all of it, 3 the rule of cohorts."""
    return F.when(version.isin("1", "2"), complexity).when(version == "3", effective_complexity(cohort, complexity, assertions))


def eroded(functions: DataFrame, threshold: int = 10) -> DataFrame:
    """Callables over the threshold, itself not included."""
    cc = effective_complexity(F.col("cohort"), F.col("complexity"), F.col("assertion_count"))
    return functions.withColumn("effective", cc).filter(F.col("effective") > threshold)


def families_of(metric: str | None, rule: str | None, severity: str | None) -> tuple[str, ...]:
    """The families a query reads (B14): a rule or severity leaves the patterns only."""
    chosen = METRICS[metric] if metric else FAMILIES
    if rule or severity:
        if "patterns" not in chosen:
            raise ValueError("rules and severities belong to patterns")
        return ("patterns",)
    return chosen


def query_findings(findings: DataFrame, members: DataFrame, functions: DataFrame, *, path: str | None = None, metric: str | None = None, rule: str | None = None, severity: str | None = None, source: str | None = None, threshold: int = 10) -> dict[str, DataFrame]:
    """Rows of each family that a query asks for, in their order.

    A path selects the findings and callables of a file, and the groups with a member in it, whole.  ``source`` is the side of
    a comparison, where tables have one.
    """
    chosen = families_of(metric, rule, severity)
    out = {}

    def on_side(df: DataFrame) -> DataFrame:
        return df.filter(F.col("source") == source) if source and "source" in df.columns else df

    def in_file(df: DataFrame) -> DataFrame:
        return df.filter(F.col("path") == path) if path else df

    if "patterns" in chosen:
        rows = in_file(on_side(findings))
        rows = rows.filter(F.col("rule_id") == rule) if rule else rows
        rows = rows.filter(F.col("severity") == severity) if severity else rows
        out["patterns"] = rows.orderBy("path", "start_line", "end_line", "rule_id")
    if "clones" in chosen:
        rows = on_side(members)
        if path:
            rows = rows.join(in_file(rows).select("group_id").distinct(), "group_id", "left_semi")
        out["clones"] = rows.orderBy("group_id", "path", "start_line", "end_line")
    if "functions" in chosen:
        out["functions"] = eroded(in_file(on_side(functions)), threshold).orderBy("path", "start_line", "end_line", "qualified_name")
    return out


def only(rows: DataFrame, what: str):
    """The one row of a look-up (B16); none or several are an error."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise LookupFailure(f"{what}: {'not found' if not found else 'ambiguous'}")
    return found[0]


def file_row(files: DataFrame, path: str):
    """The one file of a path."""
    return only(files.filter(F.col("path") == path), path)


def change_row(pairs: DataFrame, path: str):
    """The one pair of files that a path is part of, on either side."""
    return only(pairs.filter((F.col("current_path") == path) | ((F.col("baseline_path") == path) & F.col("current_path").isNull())), path)


def callable_row(functions: DataFrame, path: str, name: str):
    """The one callable of a dotted name in a file."""
    return only(functions.filter((F.col("path") == path) & (F.col("qualified_name") == name)), f"{path}:{name}")


def file_evidence(findings: DataFrame, members: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings of a file, and the groups of duplicates with a member in it, whole."""
    own = members.filter(F.col("path") == path).select("group_id").distinct()
    return findings.filter(F.col("path") == path), members.join(own, "group_id", "left_semi")


def select_targets(targets: DataFrame, *, kinds: list[str] | None = None, cohort: str | None = None, hotspots: DataFrame | None = None) -> DataFrame:
    """Review targets of any of the kinds, in a cohort, and optionally only those whose fingerprint is a hotspot's."""
    rows = targets.filter(F.col("kind").isin(kinds)) if kinds else targets
    rows = rows.filter(F.col("cohort") == cohort) if cohort else rows
    return rows.join(hotspots.select("evidence_fingerprint").distinct(), "evidence_fingerprint", "left_semi") if hotspots is not None else rows
