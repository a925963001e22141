"""Top rows of reports (G1-G10, G12).  Limits belong to display; complete results are never cut.

All are ``orderBy().limit()``, which Spark runs as a bounded heap in each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hotspots(scores: DataFrame, k: int = 5) -> DataFrame:
    """Measured files with the most points, 0 included (G1)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return scores.filter("points IS NOT NULL").orderBy(F.col("points").desc(), "path").limit(k)


def file_table(scores: DataFrame) -> DataFrame:
    """Scored files by points, then the others by path."""
    return scores.orderBy(F.col("points").desc_nulls_last(), "path")


def eroded_callables(functions: DataFrame, k: int = 5) -> DataFrame:
    """Callables by complexity times the root of their lines."""
    mass = F.col("complexity") * F.sqrt("sloc")
    return functions.withColumn("mass", mass).orderBy(F.col("mass").desc(), "path", "start_line", "end_line", "qualified_name").limit(k)


def top_findings(findings: DataFrame, k: int = 5, severities: tuple[str, ...] = ("error", "warning", "info")) -> DataFrame:
    """Findings by severity, then by flagged lines."""
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    return findings.withColumn("_r", F.when(rank == 0, 99).otherwise(rank)).orderBy("_r", F.col("flagged_lines").desc(), "path", "start_line", "end_line", "rule_id").limit(k).drop("_r")


def change_priority(deltas: DataFrame, k: int = 5) -> DataFrame:
    """Files by their first positive delta among score, combined and erosion, then by its size."""
    first = F.when(F.col("score_delta") > 0, 1).when(F.col("combined_delta") > 0, 2).when(F.col("erosion_delta") > 0, 3)
    size = F.when(first == 1, F.col("score_delta")).when(first == 2, F.col("combined_delta")).otherwise(F.col("erosion_delta"))
    return deltas.withColumn("rank", first).filter("rank IS NOT NULL").withColumn("delta", size).orderBy("rank", F.col("delta").desc(), "path").limit(k)


def clone_groups_by_size(groups: DataFrame, k: int = 5) -> DataFrame:
    return groups.orderBy(F.col("lines").desc(), "group_id").limit(k)


def ordered_groups(members: DataFrame) -> DataFrame:
    """Members in the canonical order of their groups."""
    return members.orderBy("language", "cohort", "normalization_version", "fingerprint", "path", "start_line", "end_line")


def ordered_symbols(changes: DataFrame) -> DataFrame:
    """Changes of declarations by place, then by state (G12).  ``changes``: language, cohort, path, start_line, state, ..."""
    return changes.orderBy("language", "cohort", "path", "start_line", "state")


def shared_limit(families: list[tuple[str, DataFrame, list]], k: int) -> DataFrame:
    """The first ``k`` rows of several families in turn (G7): each family's rows in its own order, as JSON."""
    out = None
    for place, (name, rows, order) in enumerate(families):
        top = rows.orderBy(*order).limit(k)
        top = top.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most k rows
        part = top.select(F.lit(place).alias("_f"), "_n", F.lit(name).alias("family"), F.to_json(F.struct(*rows.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("_f", "_n").limit(k).select("family", "row")


def directories(paths: DataFrame) -> DataFrame:
    """Every directory above the files, with its depth and number of files (G10); no metrics are made for directories."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select(F.explode(up).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("files")).withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))
