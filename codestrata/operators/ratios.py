"""Ratios of line sets and weighted sums, per file and per (language, cohort).

A project's ratio is the sum of numerators over the sum of denominators, never a mean of ratios.  A metric that could not
be measured has ``state`` unavailable and a reason; it is never zero.  Both cohorts of every language are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COHORTS = ("production", "test")
POPULATION = ["language", "cohort"]
METRIC = ["metric_id", "state", "numerator", "denominator", "value", "unit", "reason"]


def effective_complexity(cohort: Column, complexity: Column, assertions: Column) -> Column:
    """Complexity that counts: in tests, assertions are taken off where their number is known."""
    return F.when((cohort == "test") & assertions.isNotNull(), complexity - assertions).otherwise(complexity)


def population_grid(files: DataFrame) -> DataFrame:
    """Every language of ``files`` with both cohorts, empty ones too (E5)."""
    cohorts = F.explode(F.array(*map(F.lit, COHORTS)))
    return files.select("language").distinct().select("language", cohorts.alias("cohort"))


def _measured(df: DataFrame, metric_id: str, unit: str, empty_reason: str, reason: Column) -> DataFrame:
    """From ``numerator``, ``denominator`` and a reason for failure (null: none) to metric columns."""
    reason = F.coalesce(reason, F.when(F.coalesce("denominator", F.lit(0)) == 0, F.lit(empty_reason)))
    ok = reason.isNull()
    return (
        df.withColumn("_reason", reason)
        .withColumn("metric_id", F.lit(metric_id))
        .withColumn("state", F.when(ok, "measured").otherwise("unavailable"))
        .withColumn("value", F.when(ok, F.col("numerator") / F.col("denominator")))
        .withColumn("numerator", F.when(ok, F.col("numerator")))
        .withColumn("denominator", F.when(ok, F.col("denominator")))
        .withColumn("unit", F.lit(unit))
        .withColumn("reason", F.col("_reason"))
        .drop("_reason")
    )


def line_ratio(files: DataFrame, flagged: DataFrame, metric_id: str, *, per_file: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """Distinct flagged lines over source lines.

    ``files``: path, language, cohort, sloc, and optionally ``failure`` (a reason that voids the file and its cohort).
    ``flagged``: path, line (distinct or not).  ``failed``: paths with a reason for which this metric's evidence is missing;
    it voids the file's metric and its cohort's.
    """
    counts = flagged.select("path", "line").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("numerator"))
    rows = files if "failure" in files.columns else files.withColumn("failure", F.lit(None).cast("string"))
    if failed is not None:
        rows = rows.join(failed.select("path", F.col("reason").alias("_own")), "path", "left").withColumn("failure", F.coalesce("failure", "_own")).drop("_own")
    rows = rows.join(counts, "path", "left").withColumn("numerator", F.coalesce("numerator", F.lit(0)).cast("double")).withColumn("denominator", F.col("sloc").cast("double"))
    if per_file:
        out = _measured(rows.select(*POPULATION, "path", "numerator", "denominator", "failure"), metric_id, "ratio", "no-source-lines", F.col("failure"))
        return out.select(*POPULATION, "path", *METRIC)
    sums = rows.groupBy(*POPULATION).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("path"))).alias("failure"))
    out = _measured(population_grid(files).join(sums, POPULATION, "left"), metric_id, "ratio", "no-source-lines", F.col("failure"))
    return out.select(*POPULATION, *METRIC)


def erosion(files: DataFrame, functions: DataFrame, *, threshold: int = 10, per_file: bool = False) -> DataFrame:
    """Share of complexity over the threshold, weighted by the root of the source lines.

    ``functions``: path, complexity, assertion_count (may be null), sloc.
    """
    rows = files if "failure" in files.columns else files.withColumn("failure", F.lit(None).cast("string"))
    mass = functions.select("path", "complexity", "assertion_count", F.col("sloc").alias("_sloc"))
    cc = effective_complexity(F.col("cohort"), F.col("complexity"), F.col("assertion_count"))
    weighed = (
        rows.join(mass, "path", "left")
        .withColumn("_cc", cc.cast("double"))
        .withColumn("numerator", F.greatest(F.lit(0.0), F.col("_cc") - threshold) * F.sqrt("_sloc"))
        .withColumn("denominator", F.col("_cc") * F.sqrt("_sloc"))
    )
    keys = [*POPULATION, "path"] if per_file else POPULATION
    first = F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("path"))).alias("failure")
    sums = weighed.groupBy(*keys).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count("_cc").alias("n"), F.max("sloc").alias("most"), first)
    if not per_file:
        sums = population_grid(files).join(sums, POPULATION, "left")
    reason = F.coalesce(F.col("failure"), F.when(F.coalesce("most", F.lit(0)) == 0, "no-source-lines").when(F.coalesce("n", F.lit(0)) == 0, "no-functions"))
    return _measured(sums, "erosion", "ratio", "no-functions", reason).select(*keys, *METRIC)


def combined_ratio(files: DataFrame, patterns: DataFrame, clones: DataFrame, **options) -> DataFrame:
    """Lines that are flagged or cloned (E3); unavailable for the patterns' reason first, then for the clones'."""
    failed = options.pop("failed_patterns", None), options.pop("failed_clones", None)
    both = [f.select("path", "reason", F.lit(k).alias("rank")) for k, f in enumerate(failed) if f is not None]
    reasons = None
    if both:
        reasons = both[0] if len(both) == 1 else both[0].unionByName(both[1])
        reasons = reasons.groupBy("path").agg(F.min_by("reason", "rank").alias("reason"))
    return line_ratio(files, patterns.select("path", "line").unionByName(clones.select("path", "line")), "verbosity.combined", failed=reasons, **options)


def both_scopes(rows: DataFrame, additive: list[str]) -> DataFrame:
    """Sums by file and by population in one pass (E6); ``scope`` says which.  Only for columns that add up."""
    grouped = rows.groupingSets([[F.col("language"), F.col("cohort"), F.col("path")], [F.col("language"), F.col("cohort")]], "language", "cohort", "path")
    return grouped.agg(F.when(F.grouping("path") == 0, "file").otherwise("project").alias("scope"), *[F.sum(c).alias(c) for c in additive])
