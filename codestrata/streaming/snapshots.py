"""Extension: landing folders of source snapshots and streams of line changes (not among the batch operators).

Batch results over the same rows are the acceptance test of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "language string, cohort string, path string, line int, author string, ts timestamp, added int, deleted int"


def read_changes(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Line changes that arrive as Parquet files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_churn(changes: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Added and deleted lines by population and day; a day closes when the watermark has passed it."""
    rows = changes.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "language", "cohort")
    return rows.agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).select(F.col("window.start").alias("day"), "language", "cohort", "added", "deleted", (F.col("added") + F.col("deleted")).alias("churn"))


def author_sessions(changes: DataFrame, *, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    """Bursts of one author's work: changes less than ``gap`` apart."""
    rows = changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "author")
    return rows.agg(F.count(F.lit(1)).alias("changes"), F.sum("added").alias("added")).select("author", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "changes", "added")
