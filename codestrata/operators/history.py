"""Line origins over a chain of commits, and rework."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

DAY = 86_400
LINE = ["language", "cohort", "path", "line"]
ORIGIN = ["commit", "origin_path", "origin_line", "origin_ts"]


def rework_state(age: Column, has_origin: Column, window_days: int) -> Column:
    """Class of a deleted line by the age of its introduction (O3); the window includes its end."""
    return F.when(~has_origin, "unresolved").when(age < 0, "unresolved").when(age <= window_days * DAY, "recent").otherwise("outside-window")


def classify_deletions(deleted: DataFrame, origins: DataFrame, *, window_days: int = 14) -> DataFrame:
    """``deleted`` (language, cohort, path, line, ts) with ``state, reason, age_seconds`` (D25, O3): an exact look-up of the
    line's known origin."""
    rows = deleted.join(origins.select(*LINE, "origin_ts"), LINE, "left")
    age, known = F.col("ts") - F.col("origin_ts"), F.col("origin_ts").isNotNull()
    reason = F.when(~known, "unknown-introduction").when(age < 0, "timestamp-order")
    return rows.withColumn("state", rework_state(age, known, window_days)).withColumn("reason", reason).withColumn("age_seconds", F.when(known & (age >= 0), age)).drop("origin_ts")


def carry_origins(origins: DataFrame, aligned: DataFrame, added: DataFrame, commit: str, ts: int) -> DataFrame:
    """Origins after one commit (O2): aligned lines keep theirs, under the new path and line; added lines get this commit.

    ``aligned``: language, cohort, old_path, old_line, new_path, new_line.  ``added``: language, cohort, path, line.
    """
    kept = aligned.join(origins.withColumnsRenamed({"path": "old_path", "line": "old_line"}), ["language", "cohort", "old_path", "old_line"])
    kept = kept.select("language", "cohort", F.col("new_path").alias("path"), F.col("new_line").alias("line"), *ORIGIN)
    fresh = added.select(*LINE, F.lit(commit).alias("commit"), F.col("path").alias("origin_path"), F.col("line").alias("origin_line"), F.lit(ts).cast("long").alias("origin_ts"))
    return kept.unionByName(fresh)


def fold_history(anchor: DataFrame, steps: Iterable[dict], *, window_days: int = 14) -> DataFrame:
    """Rework over a first-parent chain (O1): the deleted lines of all steps with their class.

    ``steps`` in order, each ``{revision, ts, aligned, added, deleted}``.  Lines of ``anchor`` (the state before the range)
    have no known origin (O4).  After each step the origins are written down in the shared folder, so that neither the plan
    nor its recovery grows with the chain.
    """
    spark = anchor.sparkSession
    shared_dir(spark)
    origins = spark.createDataFrame([], "language string, cohort string, path string, line int, commit string, origin_path string, origin_line int, origin_ts long")
    out: DataFrame | None = None
    for step in steps:
        deleted = step["deleted"].withColumn("ts", F.lit(step["ts"]).cast("long"))
        rework = classify_deletions(deleted, origins, window_days=window_days).withColumn("revision", F.lit(step["revision"])).checkpoint()
        out = rework if out is None else out.unionByName(rework)
        origins = carry_origins(origins, step["aligned"], step["added"], step["revision"], step["ts"]).checkpoint()
    if out is None:
        return spark.createDataFrame([], "language string, cohort string, path string, line int, ts long, state string, reason string, age_seconds long, revision string")
    return out


def history_totals(steps: DataFrame) -> DataFrame:
    """Churn and net change by population (E24): ``steps`` (language, cohort, revision, added, deleted, failed)."""
    sums = steps.groupBy("language", "cohort").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.bool_or("failed").alias("_f"))
    ok = ~F.col("_f")
    return sums.select(
        "language",
        "cohort",
        F.when(ok, "measured").otherwise("unavailable").alias("state"),
        *[F.when(ok, x).alias(n) for n, x in (("added", F.col("added")), ("deleted", F.col("deleted")), ("churn", F.col("added") + F.col("deleted")), ("net", F.col("added") - F.col("deleted")))],
    )


def commit_chain(commits: DataFrame, end: str, *, start: str | None = None, max_commits: int = 100) -> DataFrame:
    """First-parent chain from ``end`` back to ``start`` (A5, O5): ``revision, parent, timestamp, step`` in order, and
    ``boundary`` (why the walk stopped before ``start``: commit-limit or missing-parent) on the first row.

    ``commits``: revision, parent (null at a root), timestamp.  The walk doubles its length each round: with jumps of 1, 2, 4
    and so on commits, of which each is two of the one before, so 1,000 commits take ten joins.
    """
    shared_dir(commits.sparkSession)
    known = commits.select("revision")
    jump = commits.filter("parent IS NOT NULL").select("revision", F.col("parent").alias("to")).join(known.withColumnRenamed("revision", "to"), "to", "left_semi").checkpoint()
    path = known.filter(F.col("revision") == end).withColumn("depth", F.lit(0))
    length = 1
    while length < max_commits:
        path = path.unionByName(path.join(jump, "revision").select(F.col("to").alias("revision"), (F.col("depth") + length).alias("depth"))).checkpoint()
        jump = jump.join(jump.select(F.col("revision").alias("to"), F.col("to").alias("_far")), "to").select("revision", F.col("_far").alias("to")).checkpoint()
        length *= 2
    stop = path.filter(F.col("revision") == F.lit(start or "")).agg(F.min("depth").alias("stop"))
    path = path.crossJoin(F.broadcast(stop)).filter((F.col("depth") < max_commits) & ((F.col("depth") < F.coalesce("stop", F.lit(max_commits))) | (F.col("depth") == 0))).drop("stop")
    walked = path.join(commits.select("revision", "parent", "timestamp"), "revision").checkpoint()
    depth = walked.agg(F.max("depth").alias("last"))
    known = commits.select(F.col("revision").alias("_p"))
    rows = walked.crossJoin(F.broadcast(depth)).join(known, F.col("parent") == F.col("_p"), "left")
    early = (F.col("depth") == F.col("last")) & F.col("parent").isNotNull() & (F.col("parent") != F.lit(start or ""))
    boundary = F.when(early & F.col("_p").isNull(), "missing-parent").when(early, "commit-limit")
    return rows.select("revision", "parent", "timestamp", (F.col("last") - F.col("depth")).alias("step"), boundary.alias("boundary"))
