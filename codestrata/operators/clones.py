"""Duplicate blocks: grouping, containment and continuity of groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .lines import enclosing_spans

POPULATION = ["language", "cohort", "normalization_version"]


def clone_groups(candidates: DataFrame) -> DataFrame:
    """Groups of equal fingerprints with at least two distinct instances: in two files, or apart in one.

    ``candidates``: language, cohort, normalization_version, fingerprint, path, start_line, end_line.  All instances of a
    kept group stay, overlapping ones too.  The statistics have partial sums, so a popular fingerprint costs no more than
    its groups' rows.
    """
    return (
        candidates.groupBy(*POPULATION, "fingerprint")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
            F.min("end_line").alias("first_end"),
            F.max("start_line").alias("last_start"),
        )
        .filter("members > 1 AND (first_path <> last_path OR first_end < last_start)")
        .withColumn("group_id", F.concat(F.lit("clone-"), F.substring(F.sha2(F.concat_ws("|", *POPULATION, "fingerprint").cast("binary"), 256), 1, 20)))
        .select(*POPULATION, "fingerprint", "group_id", "members")
    )


def clone_members(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """The instances of the kept groups, each with its group."""
    return candidates.join(groups.select(*POPULATION, "fingerprint", "group_id"), [*POPULATION, "fingerprint"])


def assignable(inner: list[list[int]]) -> bool:
    """Whether every inner member can have an enclosing member of its own: bipartite matching by augmenting paths.
    ``inner``: for each inner member the outer members that enclose it."""
    owner: dict[int, int] = {}
    for start in range(len(inner)):
        parent: dict[int, int] = {}
        queue, free = [start], None
        while queue and free is None:
            member = queue.pop()
            for outer in inner[member]:
                if outer in parent:
                    continue
                parent[outer] = member
                if outer not in owner:
                    free = outer
                    break
                queue.append(owner[outer])
        if free is None:
            return False
        while True:  # flip the path back to the start
            member = parent[free]
            before = next((o for o, m in owner.items() if m == member), None)
            owner[free] = member
            if member == start:
                break
            free = before
    return True


def _keep_in_cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice among groups that may contain each other: larger first, a group goes when one kept group encloses
    all its members one to one."""
    order = rows[["group_id", "lines", "members"]].drop_duplicates("group_id").sort_values(["lines", "group_id"], ascending=[False, True])
    inside: dict[tuple[str, str], dict[int, list[int]]] = {}
    for r in rows.itertuples():
        if isinstance(r.outer_id, str):
            inside.setdefault((r.group_id, r.outer_id), {}).setdefault(r.member, []).append(r.outer_member)
    kept: list[str] = []
    size = {r.group_id: (r.lines, r.members) for r in order.itertuples()}
    for group, (lines, members) in size.items():
        def encloses(outer: str) -> bool:
            found = inside.get((group, outer), {})
            return size[outer][0] > lines and size[outer][1] >= members and len(found) == members and assignable(list(found.values()))

        if not any(encloses(k) for k in kept):
            kept.append(group)
    return pd.DataFrame({"group_id": kept})


def without_contained(members: DataFrame) -> DataFrame:
    """``members`` less the groups that a larger kept group contains.

    ``members``: population columns, group_id, path, start_line, end_line, sloc.  Only groups that touch are decided
    together: enclosures of members make an undirected graph of groups, and each of its components is one cluster.
    """
    rows = members.withColumn("member", F.xxhash64("group_id", "path", "start_line", "end_line"))
    stats = rows.groupBy("group_id").agg(F.sum("sloc").alias("lines"), F.count(F.lit(1)).alias("members"))
    spans = rows.select(*POPULATION, "path", "group_id", "member", "start_line", "end_line")
    pairs = enclosing_spans(spans, spans, [*POPULATION, "path"]).filter("l_group_id <> r_group_id")
    pairs = pairs.select(F.col("l_group_id").alias("group_id"), F.col("l_member").alias("member"), F.col("r_group_id").alias("outer_id"), F.col("r_member").alias("outer_member"))
    clusters = connected_components(pairs.select(F.col("group_id").alias("a"), F.col("outer_id").alias("b"))).withColumnsRenamed({"node": "group_id", "component": "cluster"})
    touching = clusters.join(stats, "group_id").join(pairs, "group_id", "left")
    kept = touching.groupBy("cluster").applyInPandas(lambda pdf: _keep_in_cluster(pdf), "group_id string")
    dropped = clusters.join(kept, "group_id", "left_anti").select("group_id")
    return members.join(dropped, "group_id", "left_anti")


def clone_line_weight(members: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct lines by group."""
    from .lines import span_lines

    return span_lines(members.select("group_id", "path", "start_line", "end_line"), lines, ["path"]).groupBy("group_id").agg(F.countDistinct("path", "line").alias("lines"))


def group_state(before: str = "before", after: str = "after", unresolved: str = "unresolved", modified: str = "modified", added: str = "added", removed: str = "removed"):
    """State of a group of two snapshots, from its counts (E18); the order of the cases is part of the meaning."""
    return (
        F.when(F.col(unresolved) > 0, "unresolved")
        .when(F.col(before) < 2, "introduced")
        .when(F.col(after) < 2, "removed")
        .when(F.col(after) > F.col(before), "expanded")
        .when(F.col(after) < F.col(before), "contracted")
        .when(F.col(modified) + F.col(added) + F.col(removed) > 0, "changed")
        .otherwise("persisted")
    )
