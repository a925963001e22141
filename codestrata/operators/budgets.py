"""Change budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget_checks(limits: DataFrame, evidence: DataFrame, blockers: DataFrame) -> DataFrame:
    """``metric, maximum, observed, exceeded, state`` of each limit: observed counts the evidence; a metric with a blocker
    is incomplete, else it is exceeded or passes.  ``limits``: metric, maximum.  ``evidence``, ``blockers``: metric, ..."""
    counts = evidence.groupBy("metric").agg(F.count(F.lit(1)).alias("observed"))
    blocked = blockers.select("metric").distinct().withColumn("_b", F.lit(True))
    rows = limits.join(counts, "metric", "left").join(blocked, "metric", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    over = F.col("observed") > F.col("maximum")
    return rows.select("metric", "maximum", "observed", over.alias("exceeded"), F.when(F.col("_b"), "incomplete").when(over, "exceeded").otherwise("pass").alias("state"))


def budget_state(checks: DataFrame) -> DataFrame:
    """One row: incomplete before exceeded before pass."""
    worst = F.max(F.when(F.col("state") == "incomplete", 2).when(F.col("state") == "exceeded", 1).otherwise(0))
    return checks.agg(worst.alias("_w")).select(F.element_at(F.array(F.lit("pass"), F.lit("exceeded"), F.lit("incomplete")), F.coalesce("_w", F.lit(0)) + 1).alias("state"))


def merge_blockers(*sources: DataFrame) -> DataFrame:
    """Blockers of all sources, equal ones once, by their JSON text (E20).  Sources: metric and further columns."""
    out = None
    for s in sources:
        rest = [c for c in sorted(s.columns) if c != "metric"]
        rows = s.select("metric", F.to_json(F.struct(*rest)).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()
