"""The seven entry points: each takes sources and settings and gives tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators.budgets import budget_state
from .plans.comparison import Comparison
from .plans.snapshot import Profile, Snapshot, StrictFailure
from .plans.structure import analyze_history as _history
from .plans.structure import inspect_architecture as _architecture
from .sources.files import read_directory, resolve_languages
from .sources.git import read_commit, renames


def scan(spark: SparkSession, root: str, *, revision: str | None = None, config: Config = Config()) -> Snapshot:
    """A directory, or a commit of a repository."""
    languages = resolve_languages(config.languages) if config.languages else None
    if revision is None:
        return Snapshot(read_directory(spark, root, config.exclusions, languages=languages), config)
    return Snapshot(read_commit(spark, root, revision, languages=",".join(sorted(languages or ()))), config)


def compare(spark: SparkSession, root: str, before: str | None, after: str | None, *, other_root: str | None = None, config: Config = Config()) -> Comparison:
    """Two states, each a commit or (null) a directory; renames are hinted between two commits of one repository."""
    hints = renames(spark, root, before, after) if before and after and other_root in (None, root) else None
    return Comparison(scan(spark, root, revision=before, config=config), scan(spark, other_root or root, revision=after, config=config), hints)


def review_change(spark: SparkSession, *args, **options) -> dict[str, DataFrame]:
    change = compare(spark, *args, **options)
    return {"findings": change.finding_changes(), "errors": change.error_changes(), "dispatch": change.dispatch_changes(), "clones": change.clone_changes(), "loc": change.loc(), "metrics": change.metric_deltas()}


def review_surface(spark: SparkSession, *args, **options) -> DataFrame:
    return compare(spark, *args, **options).symbol_changes()


def inspect_architecture(spark: SparkSession, root: str, roots: list[str], forbidden: list[tuple[str, str]], **options) -> dict[str, DataFrame]:
    return _architecture(scan(spark, root, **options), roots, forbidden)


def analyze_history(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    return _history(spark, root, **options)


def evaluate_budget(change: Comparison, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Checks by metric, and the state of the whole."""
    checks = change.budget(change.before.spark.createDataFrame(list(limits.items()), "metric string, maximum int"))
    return checks, budget_state(checks)


__all__ = ["Config", "Profile", "StrictFailure", "analyze_history", "compare", "evaluate_budget", "inspect_architecture", "review_change", "review_surface", "scan"]
