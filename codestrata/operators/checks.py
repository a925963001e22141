"""Constraints as tables of violations, empty where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (M2, M8)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without an owner."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def spans_without_lines(spans: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that hold no code-bearing line of their file (M1)."""
    from .lines import span_lines

    return spans.join(span_lines(spans, lines, keys).select(*spans.columns).distinct(), spans.columns, "left_anti")


def uncovered_documents(documents: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Documents without a row of evidence, or with several, and evidence of no document."""
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((documents, "documents"), (evidence, "rows"))]
    return sides[0].join(sides[1], keys, "full_outer").na.fill(0, ["documents", "rows"]).filter("documents <> rows")


def line_delta_violations(totals: DataFrame) -> DataFrame:
    """Deltas that do not add up (M3): added and deleted against net and both sides."""
    bad = (F.col("added") - F.col("deleted") != F.col("net")) | (F.col("added") > F.col("current_sloc")) | (F.col("deleted") > F.col("baseline_sloc")) | (F.col("current_sloc") - F.col("baseline_sloc") != F.col("net"))
    return totals.filter(bad)


def unpaired_files(files: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Files that are in no pair, or in several (M4)."""
    keys = ["path", "language", "cohort"]
    paired = pairs.filter(F.col(side).isNotNull()).select(F.col(side).alias("path"), "language", "cohort")
    counts = files.select(*keys).join(paired.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "full_outer")
    return counts.filter("coalesce(n, 0) <> 1")


def score_violations(scores: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Scores that are not the sum of their parts (M5)."""
    sums = contributions.groupBy(*keys).agg(F.sum("points").alias("parts"))
    return scores.filter("points IS NOT NULL").join(sums, keys, "left").filter("parts IS NULL OR parts <> points")


def _overlapping_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Of different bands, those that share sizes with one before them; no end means 0 or 1e18.

    A band a meets a band b if a.low < b.high and b.low < a.high.  One of the two is proper then (low < high), for two that are
    not never meet.  So a band meets one before it if the highest end of proper bands that begin before it is above its low;
    one that is not proper stands at its high, and before all that begin there.
    """
    low, high = F.coalesce(F.col("min_sloc").cast("double"), F.lit(0.0)), F.coalesce(F.col("max_sloc").cast("double"), F.lit(1e18))
    bands = bands.select(*keys, low.alias("_low"), high.alias("_high")).withColumn("_proper", F.col("_low") < F.col("_high"))
    before = Window.partitionBy(*keys).orderBy(F.least("_low", "_high"), "_proper").rowsBetween(Window.unboundedPreceding, -1)
    return bands.withColumn("_reach", F.max(F.when(F.col("_proper"), F.col("_high"))).over(before)).filter("_reach > _low")


def profile_violations(populations: DataFrame) -> DataFrame:
    """Populations with unsorted or uneven distributions, and overlapping bands of one kind, cohort, model and metric (M6)."""
    keys = ["kind", "cohort", "model", "metric_id"]
    unsorted = populations.filter("values <> array_sort(values) OR size(values) = 0").select(*keys, F.lit("values").alias("rule"))
    overlap = populations.select(*keys, "min_sloc", "max_sloc").dropna(subset=keys).distinct()  # null keys are in no pair
    overlap = _overlapping_bands(overlap, keys).select(*keys, F.lit("bands").alias("rule"))
    uneven = populations.groupBy("kind", "cohort", "model", "min_sloc", "max_sloc").agg(F.count_distinct(F.size("values")).alias("n")).filter("n > 1")
    return unsorted.unionByName(overlap).distinct().unionByName(uneven.select("kind", "cohort", "model", F.lit(None).cast("string").alias("metric_id"), F.lit("sizes").alias("rule")))


def chain_violations(commits: DataFrame) -> DataFrame:
    """Steps whose parent is not the step before (M7).  ``commits``: revision, parent, step."""
    before = commits.select((F.col("step") + 1).alias("step"), F.col("revision").alias("_before"))
    return commits.join(before, "step").filter("NOT (parent <=> _before)").drop("_before")
