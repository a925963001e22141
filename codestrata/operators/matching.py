"""Matching of two snapshots: files, metrics and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["language", "cohort"]


def match_files(before: DataFrame, after: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Pairs of the files of two snapshots: ``language, cohort, baseline_path, current_path, kind``.

    Stages work on what the stage before left: equal paths (D1), hinted renames (D2), equal contents with the k-th old path
    for the k-th new one (D3); what is left is deleted or added (D4).  Populations never cross.  ``before`` and ``after``:
    path, language, cohort, content_hash (null: unreadable).  ``hints``: baseline_path, current_path; each side is used
    once, in order.
    """
    old = before.select(*KEY, F.col("path").alias("baseline_path"), F.col("content_hash").alias("old_hash"))
    new = after.select(*KEY, F.col("path").alias("current_path"), F.col("content_hash").alias("new_hash"))
    same = (old.baseline_path == new.current_path) & (old.language == new.language) & (old.cohort == new.cohort)
    both = old.join(new.withColumnsRenamed({k: f"_{k}" for k in KEY}), (F.col("baseline_path") == F.col("current_path")) & (F.col("language") == F.col("_language")) & (F.col("cohort") == F.col("_cohort")), "full_outer")
    both = both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in KEY], "baseline_path", "old_hash", "current_path", "new_hash")
    del same
    unreadable = F.col("old_hash").isNull() | F.col("new_hash").isNull()
    paired = both.filter("baseline_path IS NOT NULL AND current_path IS NOT NULL").withColumn(
        "kind", F.when(unreadable, "unresolved").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    )
    gone = both.filter("current_path IS NULL").select(*KEY, "baseline_path", "old_hash")
    come = both.filter("baseline_path IS NULL").select(*KEY, "current_path", "new_hash")
    out = [paired.select(*KEY, "baseline_path", "current_path", "kind")]
    if hints is not None:
        use = hints.filter("baseline_path <> current_path").distinct()
        found = use.join(gone, "baseline_path").join(come, ["current_path", *KEY])
        found = found.withColumn("_a", F.row_number().over(Window.partitionBy(*KEY, "baseline_path").orderBy("current_path"))).filter("_a = 1")
        found = found.withColumn("_b", F.row_number().over(Window.partitionBy(*KEY, "current_path").orderBy("baseline_path"))).filter("_b = 1")
        kind = F.when(F.col("old_hash").isNull() | F.col("new_hash").isNull(), "unresolved").otherwise("renamed")
        hinted = found.select(*KEY, "baseline_path", "current_path", kind.alias("kind"))
        out.append(hinted)
        gone, come = gone.join(hinted, [*KEY, "baseline_path"], "left_anti"), come.join(hinted, [*KEY, "current_path"], "left_anti")
    a = gone.filter("old_hash IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, "old_hash").orderBy("baseline_path"))).withColumnRenamed("old_hash", "hash")
    b = come.filter("new_hash IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, "new_hash").orderBy("current_path"))).withColumnRenamed("new_hash", "hash")
    moved = a.join(b, [*KEY, "hash", "_k"], "full_outer")
    out.append(moved.select(*KEY, "baseline_path", "current_path", F.when(F.col("current_path").isNull(), "deleted").when(F.col("baseline_path").isNull(), "added").otherwise("renamed").alias("kind")))
    out.append(gone.filter("old_hash IS NULL").select(*KEY, "baseline_path", F.lit(None).cast("string").alias("current_path"), F.lit("deleted").alias("kind")))
    out.append(come.filter("new_hash IS NULL").select(*KEY, F.lit(None).cast("string").alias("baseline_path"), "current_path", F.lit("added").alias("kind")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def pair_order() -> list:
    """The order in which pairs are reported."""
    return [F.coalesce("current_path", "baseline_path"), F.coalesce("baseline_path", F.lit("")), F.col("kind")]


def metric_deltas(before: DataFrame, after: DataFrame, scope: list[str], *, tolerance: float = 0.0) -> DataFrame:
    """Current less baseline value by scope and metric (D21); unavailable, with a reason, unless both sides are measured in
    the same unit.  Inputs: scope, metric_id, state, value, unit."""
    keys = [*scope, "metric_id"]
    a = before.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in ("state", "value", "unit")])
    b = after.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in ("state", "value", "unit")])
    reason = (
        F.when(F.col("_old_state").isNull(), "missing-baseline")
        .when(F.col("_new_state").isNull(), "missing-current")
        .when(F.col("_old_state") != "measured", "baseline-unavailable")
        .when(F.col("_new_state") != "measured", "current-unavailable")
        .when(F.col("_old_unit") != F.col("_new_unit"), "incompatible-definition")
    )
    rows = a.join(b, keys, "full_outer").withColumn("reason", reason)
    delta = F.col("_new_value") - F.col("_old_value")
    return rows.select(
        *keys,
        F.when(F.col("reason").isNull(), "measured").otherwise("unavailable").alias("state"),
        F.when(F.col("reason").isNull(), F.when(F.abs(delta) <= tolerance, 0.0).otherwise(delta)).alias("value"),
        F.coalesce("_new_unit", "_old_unit").alias("unit"),
        "reason",
    )


def loc_totals(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Sums of line deltas (E13-E15): ``baseline_sloc, current_sloc, added, deleted, net, growth``; any unavailable row
    makes its total unavailable, a parse failure's reason first.  ``deltas``: by, the counts, reason (null: measured)."""
    sums = deltas.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("baseline_sloc", "current_sloc", "added", "deleted")],
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct(F.col("reason") != "parse-failed", "reason"))).alias("reason"),
    )
    ok = F.col("reason").isNull()
    net = F.col("added") - F.col("deleted")
    counts = [F.when(ok, F.col(c)).alias(c) for c in ("baseline_sloc", "current_sloc", "added", "deleted")]
    growth = F.when(ok & (F.col("baseline_sloc") > 0), net / F.col("baseline_sloc"))
    return sums.select(*by, F.when(ok, "measured").otherwise("unavailable").alias("state"), *counts, F.when(ok, net).alias("net"), growth.alias("growth"), "reason")


def side_tagged(before: DataFrame, after: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Evidence of both snapshots in one table, with the side in ``source`` and before the ids (H5)."""
    sides = [df.withColumn("source", F.lit(s)).withColumn(id_col, F.concat(F.lit(f"{s}:"), F.col(id_col))) for s, df in (("baseline", before), ("current", after))]
    return sides[0].unionByName(sides[1])


def take_away(rows: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference by key (H3): the k-th row of a key goes for the k-th use.  Both have an ``ord`` column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    taken = used.withColumn("_k", place).select(*keys, "_k")
    return rows.withColumn("_k", place).join(taken, [*keys, "_k"], "left_anti").drop("_k")


def symmetric_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on one side only (H7): empty where two sets are equal."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
