"""Review targets of a whole snapshot: the seven kinds of evidence, with what their analysis depended on."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import clone_runs, complexity, rules
from ..operators import architecture, reviews
from .snapshot import Snapshot

#: Versions of the experimental detectors.
EXPERIMENT_VERSION = "experiment-1"
#: Kind -> family, symbol, and the rows that are evidence.
FAMILIES = {
    "pattern": ("findings", "rule_id", "true"),
    "complexity": ("functions", "qualified_name", "true"),
    "model": ("models", "model", "state = 'assessed'"),
    "variant": ("variants", "symbol", "state = 'assessed'"),
    "derived": ("derived", "concat_ws(':', symbol, derived, source)", "state = 'assessed' AND derived IS NOT NULL"),
    "error": ("handlers", "symbol", "state = 'assessed' AND fallback_kind IS NOT NULL"),
}


def definition(kind: str, snapshot: Snapshot) -> tuple[str, str]:
    """Version and settings (JSON) of the analysis behind a kind of evidence."""
    c = snapshot.config
    if kind == "pattern":
        return rules.RULE_SET_VERSION, ""
    if kind == "clone":
        return clone_runs.NORMALIZATION_VERSION, json.dumps([c.clone_min_statements, c.clone_min_sloc])
    if kind == "complexity":
        return complexity.COMPLEXITY_VERSION, json.dumps([c.complexity_threshold])
    return EXPERIMENT_VERSION, ""


def review_targets(snapshot: Snapshot, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All targets of the kinds asked for (all of them by default)."""
    parts = []
    for kind, (family, symbol, which) in FAMILIES.items():
        if kinds is None or kind in kinds:
            version, settings = definition(kind, snapshot)
            parts.append(reviews.evidence_rows(snapshot.family(family).filter(which), kind, symbol, version=version, settings=settings))
    if kinds is None or "clone" in kinds:
        version, settings = definition("clone", snapshot)
        members = snapshot.clone_members.join(snapshot.files.select("path", F.col("source_sha256").alias("_h")), "path").drop("source_sha256").withColumnRenamed("_h", "source_sha256")
        known = list(snapshot.config.boundaries)
        boundaries = None
        if known:
            table = snapshot.spark.createDataFrame(known, "name string, prefix string")
            boundaries = architecture.assign_boundaries(members.select("path"), table)
        parts.append(reviews.duplicate_rows(members, version=version, settings=settings, boundaries=boundaries))
    return reviews.targets(reduce(DataFrame.unionByName, parts))
