"""Imports between modules, and histories of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import architecture, graph, history
from ..sources import git
from .comparison import Comparison
from .snapshot import Snapshot


def resolved_imports(snapshot: Snapshot, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """The module index, and all imports with importer, state, imported module and reason."""
    index = architecture.module_index(snapshot.files.select("path"), roots)
    raw = snapshot.family("imports").join(index.filter("status = 'unique'"), "path").withColumnRenamed("module", "importer")
    package = F.col("path").endswith("__init__.py")
    base = architecture.absolute_target(F.col("importer"), package, F.col("level"), F.col("target"))
    rows = raw.withColumn("base", base).withColumn("child", F.when(F.col("name").isNotNull() & F.col("base").isNotNull(), F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), "name")))
    known = index.filter("status = 'unique'").select(F.col("module").alias("child"), F.lit(True).alias("_child"))
    members = snapshot.evidence.select("path", F.explode("members").alias("member")).join(index.filter("status = 'unique'"), "path").select(F.col("module").alias("base"), F.col("member").alias("name"), F.lit(True).alias("_member"))
    rows = rows.join(known, "child", "left").join(members.distinct(), ["base", "name"], "left")
    # A submodule is meant unless the package itself binds the name.
    rows = rows.withColumn("target", F.when(F.col("_child") & F.col("_member").isNull(), F.col("child")).otherwise(F.col("base"))).withColumnRenamed("reason", "syntax_reason").drop("_child", "_member", "child", "base")
    found = architecture.resolve_imports(rows, index)
    dynamic = F.col("syntax_reason") == "dynamic"
    found = found.withColumn("state", F.when(dynamic, "unresolved").otherwise(F.col("state"))).withColumn("reason", F.when(dynamic, "dynamic").otherwise(F.col("reason"))).withColumn("imported", F.when(~F.coalesce(dynamic, F.lit(False)), F.col("imported")))
    return index, found


def inspect_architecture(snapshot: Snapshot, roots: list[str], forbidden: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Imports, fan-out, cycles and violations of a policy."""
    index, imports = resolved_imports(snapshot, roots)
    edges = imports.filter("state = 'internal'").select("importer", "imported").checkpoint()
    modules = index.filter("status = 'unique'").select("module")
    rules = snapshot.spark.createDataFrame(forbidden, "source string, target string")
    return {"imports": imports, "fan_out": graph.fan_out(modules, edges), "cycles": graph.cycles(edges), "violations": graph.policy_violations(edges, rules)}


def analyze_history(spark: SparkSession, root: str, end: str = "HEAD", *, start: str | None = None, max_commits: int = 50, window_days: int = 14, config: Config = Config()) -> dict[str, DataFrame]:
    """Line deltas and rework over a first-parent chain; each commit's snapshot is parsed once and serves two steps."""
    end = git.resolve(root, end)
    start = git.resolve(root, start) if start else None
    chain = history.commit_chain(git.commits(spark, root, end, max_commits + 2), end, start=start, max_commits=max_commits).orderBy("step").collect()  # at most max_commits rows
    anchor = chain[0].parent
    empty = spark.createDataFrame([], git.TREE)
    before = Snapshot(git.read_commit(spark, root, anchor) if anchor and chain[0].boundary != "missing-parent" else empty, config)
    steps, totals, previous = [], None, anchor
    for commit in chain:
        after = Snapshot(git.read_commit(spark, root, commit.revision), config)
        hints = git.renames(spark, root, previous, commit.revision) if previous and chain[0].boundary != "missing-parent" else None
        change = Comparison(before, after, hints)
        d = change.line_deltas
        pop = ["language", "cohort"]
        aligned = d.select(*pop, F.col("baseline_path").alias("old_path"), F.col("current_path").alias("new_path"), F.explode("aligned").alias("l")).select(*pop, "old_path", F.col("l.old").alias("old_line"), "new_path", F.col("l.new").alias("new_line"))
        added = d.select(*pop, F.col("current_path").alias("path"), F.explode("added").alias("line"))
        deleted = d.select(*pop, F.col("baseline_path").alias("path"), F.explode("deleted").alias("line"))
        steps.append({"revision": commit.revision, "ts": commit.timestamp, "aligned": aligned, "added": added, "deleted": deleted})
        count = d.groupBy(*pop).agg(F.sum(F.size("added")).alias("added"), F.sum(F.size("deleted")).alias("deleted"), F.bool_or(F.col("reason").isNotNull()).alias("failed")).withColumn("revision", F.lit(commit.revision))
        totals = count if totals is None else totals.unionByName(count)
        before, previous = after, commit.revision
    lines = before.lines
    schema = "revision string, parent string, timestamp long, step int, boundary string"
    return {"commits": spark.createDataFrame(chain, schema), "rework": history.fold_history(lines, steps, window_days=window_days), "steps": totals, "totals": history.history_totals(totals)}
