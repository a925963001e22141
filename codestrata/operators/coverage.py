"""Coverage, diagnostics and the order of reasons for unavailable metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches_any


def cohort_of(path: Column, production: list[str], test: list[str]) -> Column:
    """Cohort of a path: test globs win over production globs; null outside both (B2)."""
    return F.when(matches_any(path, test), "test").when(matches_any(path, production), "production")


def classify(inventory: DataFrame, *, production: list[str], test: list[str], exclusions: list[str], markers: list[str]) -> DataFrame:
    """``state`` and ``reason`` of every listed file, by the first rule that holds.

    ``inventory``: path, language (null: unsupported), is_symlink, git_ignored, read_error, content.  Files of languages
    that were not asked for are filtered out by the caller, before their bytes are read, and counted nowhere.
    """
    path, cohort = F.col("path"), cohort_of(F.col("path"), production, test)
    generated = F.lit(False)
    for marker in markers:
        generated = generated | F.coalesce(F.expr(f"contains(content, X'{marker.encode().hex()}')"), F.lit(False))
    reason = (
        F.when(F.col("is_symlink"), "symlink")
        .when(matches_any(path, exclusions), "configured exclusion")
        .when(F.col("git_ignored"), "git ignored")
        .when(F.col("language").isNull(), "unsupported")
        .when(cohort.isNull(), "outside configured cohorts")
        .when(F.col("read_error").isNotNull(), "read error")
        .when(generated, "generated")
    )
    state = F.when(reason == "read error", "failed").when(reason == "unsupported", "unsupported").when(reason.isNotNull(), "excluded").otherwise("scored")
    return inventory.withColumn("cohort", cohort).withColumn("reason", reason).withColumn("state", state)


def coverage_counts(classified: DataFrame) -> DataFrame:
    """Files and source lines by state, cohort, language and reason (E9); only scored rows have lines."""
    return classified.groupBy("state", "cohort", "language", "reason").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.when(F.col("state") == "scored", F.col("sloc"))).alias("sloc"))


def dense_ids(rows: DataFrame, kind: str, order: list[str], *, within: list[str] | None = None) -> DataFrame:
    """``id`` by sorted position among distinct rows, ``kind-0001`` and so on.

    Positions are made without a global window: a range partitioning, the counts before each range, and a row number in
    it.  ``within`` numbers each group by itself.
    """
    rows = rows.distinct()
    if within:
        place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        return rows.withColumn("id", F.format_string(f"{kind}-%04d", place))
    from ..session import shared_dir

    shared_dir(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").withColumn("id", F.format_string(f"{kind}-%04d", place)).drop("_part", "_before")


def failure_reasons(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``files`` with ``failure``: the reason of the first error in a failed file (E7), in the order of the diagnostics' ids."""
    errors = diagnostics.filter("severity = 'error' AND path IS NOT NULL").groupBy("path").agg(F.min_by("code", "id").alias("_code"))
    return files.join(errors, "path", "left").withColumn("failure", F.when(F.col("parse_state") == "failed", F.coalesce("_code", F.lit("parse-failed")))).drop("_code")


def state_counts(changes: DataFrame, states: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows by state, with 0 for states that do not occur."""
    by = by or []
    all_states = F.explode(F.array(*map(F.lit, states))).alias("state")
    grid = changes.select(*by).distinct().select(*by, all_states) if by else changes.sparkSession.range(1).select(all_states)
    counts = changes.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [*by, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def experimental_coverage(rows: DataFrame) -> DataFrame:
    """Encountered, assessed and unresolved candidates, findings, and reasons in order (E21).  ``rows``: state (assessed or
    unresolved), reason, is_finding."""
    by_reason = rows.filter("state = 'unresolved'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = by_reason.agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("encountered"),
        F.count(F.when(F.col("state") == "assessed", 1)).alias("assessed"),
        F.count(F.when(F.col("state") == "unresolved", 1)).alias("unresolved"),
        F.count(F.when(F.col("is_finding"), 1)).alias("findings"),
    )
    return totals.crossJoin(F.broadcast(reasons))
