"""Module index, import resolution and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import prefixes


def module_index(files: DataFrame, roots: list[str]) -> DataFrame:
    """``path, module, status`` of source files under the longest fitting root (C16): ``unique``, ``ambiguous`` (several
    files of one name), ``invalid`` (a part that is no identifier) or ``outside`` (under no root)."""
    path = F.col("path")
    rest = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        clean = root.strip("/")
        if clean in ("", "."):
            rest = path
        else:
            rest = F.when(path.startswith(f"{clean}/"), F.expr(f"substr(path, {len(clean) + 2})")).otherwise(rest)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    valid = name.rlike(r"^[^\W\d]\w*(\.[^\W\d]\w*)*$")
    rows = files.withColumn("module", name)
    several = F.count(F.lit(1)).over(Window.partitionBy("module")) > 1
    status = F.when(F.col("module").isNull(), "outside").when(~valid, "invalid").when(several, "ambiguous").otherwise("unique")
    return rows.withColumn("status", status).select("path", F.when(F.col("status") != "outside", F.col("module")).alias("module"), "status")


def absolute_target(importer: Column, is_package: Column, level: Column, target: Column) -> Column:
    """Dotted target of an import with ``level`` leading dots; null where the dots lead out of the package."""
    parts = F.split(importer, r"\.", -1)
    keep = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), ".")
    joined = F.when(F.coalesce(target, F.lit("")) == "", base).when(base == "", target).otherwise(F.concat_ws(".", base, target))
    return F.when(level == 0, target).when(keep <= 0, F.lit(None).cast("string")).otherwise(joined)


def resolve_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """``imports`` (importer, target, ...) with ``state``, ``imported`` and ``reason`` (D9), by the first rule that holds:
    out of the package, ambiguous, internal, missing under a known first part, external."""
    names = index.filter("module IS NOT NULL").groupBy(F.col("module").alias("target")).agg(F.max(F.when(F.col("status") == "ambiguous", 2).when(F.col("status") == "unique", 1).otherwise(0)).alias("_kind"))
    tops = index.filter("module IS NOT NULL").select(F.explode(F.slice(prefixes(F.col("module")), 1, 1)).alias("_top")).distinct().withColumn("_known", F.lit(True))
    rows = imports.join(names, "target", "left").withColumn("_top", F.split("target", r"\.")[0]).join(tops, "_top", "left")
    state = F.when(F.col("target").isNull() | (F.col("_kind") == 2), "unresolved").when(F.col("_kind") == 1, "internal").when(F.col("_known"), "unresolved").otherwise("external")
    reason = F.when(F.col("target").isNull(), "relative-beyond-root").when(F.col("_kind") == 2, "ambiguous").when(F.col("_kind") == 1, None).when(F.col("_known"), "missing-internal")
    return rows.withColumn("state", state).withColumn("reason", reason).withColumn("imported", F.when(F.col("state") == "internal", F.col("target"))).drop("_kind", "_top", "_known")


def assign_boundaries(paths: DataFrame, boundaries: DataFrame, *, separator: str = "/") -> DataFrame:
    """``path, boundary``: the boundary with the longest prefix of the path, ties by name; null for none.

    ``boundaries``: name, prefix.  A path's own prefixes are joined by equality.
    """
    dealt = paths.select("path").distinct().withColumn("prefix", F.explode(prefixes(F.col("path"), separator)))
    best = dealt.join(boundaries.select("name", "prefix"), "prefix").groupBy("path").agg(F.min_by("name", F.struct(-F.length("prefix"), "name")).alias("boundary"))
    return paths.select("path").distinct().join(best, "path", "left")


def boundary_relation(members: DataFrame, by: list[str]) -> DataFrame:
    """Whether groups lie within one boundary (E27): ``unknown`` if any member has none, ``within`` for one label, else
    ``cross``.  ``members``: by, boundary."""
    got = members.groupBy(*by).agg(F.bool_or(F.col("boundary").isNull()).alias("_n"), F.min("boundary").alias("_a"), F.max("boundary").alias("_b"))
    return got.select(*by, F.when(F.col("_n"), "unknown").when(F.col("_a") == F.col("_b"), "within").otherwise("cross").alias("relation"))
