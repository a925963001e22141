"""Attributed review decisions: targets, resolution and the rules of a ledger (N1-N8, D22, D23, F11, B8 of kinds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import json_digest

#: Columns of every target.
TARGET = ["review_id", "kind", "language", "cohort", "symbol", "paths", "evidence_fingerprint", "source_hashes", "boundary", "analysis_fingerprint", "unavailable"]
#: Report -> kinds of targets that can be judged from it.
ASSESSABLE = {"snapshot": ("clone", "complexity", "pattern"), "models": ("model",), "variants": ("variant",), "derived": ("derived",), "errors": ("error",)}


def targets(evidence: DataFrame) -> DataFrame:
    """Rows of evidence as review targets, each once, in the order of their ids.

    ``evidence``: kind, language, cohort, symbol, paths (array), evidence_fingerprint, source_hashes (array, null elements for
    unknown ones), boundary, analysis_version (null: unknown), settings (JSON text).
    """
    subject = F.to_json(F.struct("kind", "language", "cohort", F.coalesce("symbol", F.lit("")).alias("symbol"), F.array_sort("paths").alias("paths")))
    unavailable = F.when(F.exists("source_hashes", lambda h: h.isNull()) | (F.size("source_hashes") == 0), "missing-source-hash").when(F.col("analysis_version").isNull(), "missing-analysis-version")
    definition = F.to_json(F.struct("kind", F.coalesce("analysis_version", F.lit("")).alias("version"), F.coalesce("settings", F.lit("")).alias("settings")))
    rows = evidence.withColumn("review_id", F.concat("kind", F.lit(":"), json_digest(subject))).withColumn("analysis_fingerprint", json_digest(definition)).withColumn("unavailable", unavailable)
    return rows.withColumn("paths", F.array_sort("paths")).select(*TARGET).dropDuplicates(["review_id", "evidence_fingerprint"])


def evidence_rows(rows: DataFrame, kind: str, symbol: str, *, source: str = "source_sha256", version: str | None, settings: str = "", boundary=None) -> DataFrame:
    """Rows of one family in one file each, as ``targets`` takes them: the symbol and all that the row says.  ``rows``: path,
    language, cohort, the source hash, and the family's own columns."""
    own = [c for c in rows.columns if c not in ("path", "language", "cohort", source)]
    evidence = json_digest(F.to_json(F.struct("path", *own)))
    return rows.select(
        F.lit(kind).alias("kind"), "language", "cohort", F.expr(symbol).alias("symbol"), F.array("path").alias("paths"), evidence.alias("evidence_fingerprint"), F.array(source).alias("source_hashes"),
        (F.lit(None).cast("string") if boundary is None else boundary).alias("boundary"), F.lit(version).cast("string").alias("analysis_version"), F.lit(settings).alias("settings"),
    )


def duplicate_rows(members: DataFrame, *, version: str, settings: str = "", boundaries: DataFrame | None = None) -> DataFrame:
    """Groups of duplicates as ``targets`` takes them; their boundary is that of their members' paths.  ``members``: group_id,
    language, cohort, fingerprint, path, start_line, end_line, source_sha256.  ``boundaries``: path, boundary."""
    rows = members.withColumn("boundary", F.lit(None).cast("string")) if boundaries is None else members.join(boundaries, "path", "left")
    place = F.struct("path", "start_line", "end_line", "boundary", F.col("source_sha256").alias("hash"))
    groups = rows.groupBy("group_id", "language", "cohort", "fingerprint").agg(F.array_sort(F.collect_list(place)).alias("m"))  # what one target shows
    paths = F.array_distinct("m.path")
    hashes = F.transform(paths, lambda p: F.filter("m", lambda x: x.path == p)[0].hash)
    return groups.select(
        F.lit("clone").alias("kind"), "language", "cohort", F.lit("clone").alias("symbol"), paths.alias("paths"),
        json_digest(F.to_json(F.struct("fingerprint", F.transform("m", lambda x: F.struct(x.path.alias("path"), x.start_line.alias("start_line"), x.end_line.alias("end_line"))).alias("m")))).alias("evidence_fingerprint"),
        hashes.alias("source_hashes"), F.array_join(F.array_sort(F.array_distinct(F.array_compact("m.boundary"))), ",").alias("boundary"), F.lit(version).alias("analysis_version"), F.lit(settings).alias("settings"),
    )


def select_targets(found: DataFrame, *, kind: str | None = None, path: str | None = None, symbol: str | None = None, language: str | None = None, cohort: str | None = None, review_id: str | None = None) -> DataFrame:
    """Targets that match all filters given."""
    for column, value in (("kind", kind), ("symbol", symbol), ("language", language), ("cohort", cohort), ("review_id", review_id)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    return found if path is None else found.filter(F.array_contains("paths", path))


def latest(events: DataFrame, key: str = "review_id") -> DataFrame:
    """The last event of each review."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*names), "sequence").alias("e")).select(key, "e.*")


def stale_causes(decided: str = "d", current: str = "c"):
    """What differs between a decision's anchor and the present one."""
    pairs = (("evidence", "evidence_fingerprint"), ("source", "source_hashes"), ("boundary", "boundary"), ("analysis-definition", "analysis_fingerprint"))
    causes = [F.when(~F.col(f"{decided}.{c}").eqNullSafe(F.col(f"{current}.{c}")), name) for name, c in pairs]
    return F.array_compact(F.array(*causes, F.when(F.col(f"{current}.unavailable").isNotNull(), "unavailable")))


def resolve(events: DataFrame, present: DataFrame, report: str) -> DataFrame:
    """State of each review's last decision against a report's targets (D22): ``current``, ``stale`` with causes, ``missing``,
    or ``not-in-selected-report`` for kinds that the report cannot show."""
    kinds = ASSESSABLE[report]
    joined = latest(events).alias("d").join(present.alias("c"), F.col("d.review_id") == F.col("c.review_id"), "left")
    causes = stale_causes()
    state = F.when(~F.col("d.kind").isin(*kinds), "not-in-selected-report").when(F.col("c.review_id").isNull(), "missing").when(F.size(causes) > 0, "stale").otherwise("current")
    return joined.select("d.review_id", "d.sequence", "d.disposition", state.alias("state"), F.when(state == "stale", causes).otherwise(F.array().cast("array<string>")).alias("causes"))


def superseded(events: DataFrame) -> DataFrame:
    """The first event that links each legacy decision."""
    linked = events.filter("supersedes_legacy_id IS NOT NULL")
    return linked.groupBy("supersedes_legacy_id").agg(F.min("sequence").alias("sequence"), F.min_by("review_id", "sequence").alias("review_id"))


def legacy_matches(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """Legacy decisions with the groups they may speak of (D23): by id, or by equal population and set of paths.  Two
    equi-joins, so neither side is compared with all of the other."""
    by_id = decisions.select("decision_id", "group_id").join(groups.select("group_id").distinct(), "group_id").select("decision_id", "group_id")
    same = ["language", "cohort", "path_set"]
    sets = [df.withColumn("path_set", F.array_join(F.array_sort(F.array_distinct("paths")), "\0")) for df in (decisions.select("decision_id", "language", "cohort", "paths"), groups.select("group_id", "language", "cohort", "paths"))]
    return by_id.union(sets[0].join(sets[1], same).select("decision_id", "group_id")).distinct()


def ledger_violations(events: DataFrame) -> DataFrame:
    """What breaks a ledger's rules (N6, N7): sequence numbers with gaps or repeats, ids whose family changes, and legacy
    decisions with several histories."""
    ends = events.agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("sequence").alias("k"))
    gaps = ends.filter("n > 0 AND (a <> 1 OR b <> n OR k <> n)").select(F.lit("sequence").alias("rule"), F.lit(None).cast("string").alias("subject"))
    family = events.groupBy("review_id").agg(F.countDistinct("kind", "language", "cohort").alias("k")).filter("k > 1").select(F.lit("family").alias("rule"), F.col("review_id").alias("subject"))
    legacy = events.filter("supersedes_legacy_id IS NOT NULL").groupBy("supersedes_legacy_id").agg(F.countDistinct("review_id").alias("k")).filter("k > 1").select(F.lit("legacy-history").alias("rule"), F.col("supersedes_legacy_id").alias("subject"))
    return gaps.unionByName(family).unionByName(legacy)


def append(events: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` with new ones under the next sequence numbers (A13); one writer at a time."""
    last = events.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy("recorded_at", "review_id"))  # a hand-made batch
    numbered = new.drop("sequence").withColumn("_k", place).crossJoin(F.broadcast(last)).withColumn("sequence", (F.col("_k") + F.col("last")).cast(events.schema["sequence"].dataType))
    return events.unionByName(numbered.drop("_k", "last"))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``new`` in place of those of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)
