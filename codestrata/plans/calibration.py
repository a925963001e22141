"""Reference populations from a corpus of pinned projects, and the profile they make up."""

from __future__ import annotations

import hashlib
import subprocess
import tomllib
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import scoring
from ..sources.files import read_directory
from ..sources.reports import save_profile
from .snapshot import MEASURING, MODELS, SCORED, Snapshot, _plain

#: Half-open ranges of file sizes by band.
RANGES = {"1-20": (1, 21), "21-100": (21, 101), "101-500": (101, 501), "501+": (501, None)}
#: The score models of a profile that is built here.
DEFAULT_MODELS = [
    {"model_id": "snapshot", "eligibility": "all-metrics", "inputs": [{"metric_id": "verbosity.combined", "weight": 0.5}, {"metric_id": "erosion", "weight": 0.5}]},
    {"model_id": "verbosity-only", "eligibility": "no-functions", "inputs": [{"metric_id": "verbosity.combined", "weight": 1.0}]},
]
DEFAULT_BANDS = [{"label": "low", "lower": 0}, {"label": "moderate", "lower": 40}, {"label": "high", "lower": 70}]


def verified(cache: Path, project: dict) -> Path:
    """The folder of a corpus project, at its pinned revision, without changes, and with its licence."""
    root = (cache / project["name"]).resolve()
    if not root.is_relative_to(cache.resolve()) or not root.is_dir():
        raise ValueError(f"no folder of {project['name']} in {cache}")

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True).stdout.strip()

    if git("rev-parse", "HEAD") != project["revision"]:
        raise ValueError(f"{project['name']} is not at its pinned revision")
    if git("status", "--porcelain", "--untracked-files=all"):
        raise ValueError(f"{project['name']} has changes")
    licence = (root / project["license_file"]).resolve()
    if not licence.is_relative_to(root) or not licence.is_file():
        raise ValueError(f"{project['name']} lacks its licence file")
    return root


def observations(snapshot: Snapshot, project: str) -> DataFrame:
    """What one project adds to reference populations: ``kind, cohort, model, band, scope_id, metric_id, value`` of each scope
    that a model takes; projects have no band."""
    out = None
    for kind in ("project", "file"):
        metrics = snapshot.metrics(per_file=kind == "file").filter(F.col("metric_id").isin(SCORED))
        keys = ["path", "language", "cohort"] if kind == "file" else ["language", "cohort"]
        models = scoring.model_of(metrics.select(*keys, "metric_id", "state", "reason")).filter("model IS NOT NULL")
        rows = metrics.filter("state = 'measured'").join(models, keys)
        if kind == "file":
            rows = rows.join(snapshot.files.select(*keys, "sloc"), keys).withColumn("band", scoring.sloc_band(F.col("sloc")))
        else:
            rows = rows.withColumn("band", F.lit(None).cast("string"))
        scope = F.concat_ws("|", F.lit(project), *keys).alias("scope_id")
        rows = rows.select(F.lit(kind).alias("kind"), "cohort", "model", "band", scope, "metric_id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def populations(found: DataFrame, min_samples: int) -> list[dict]:
    """Populations as a profile's document holds them, in order."""
    names = {v: m["model_id"] for m in DEFAULT_MODELS for k, v in MODELS.items() if m["eligibility"] == k}
    out: dict[tuple, dict] = {}
    named = found.withColumn("band", F.coalesce("band", F.lit("")))
    for r in scoring.build_populations(named, min_samples=min_samples).orderBy("kind", "cohort", "model", "band", "metric_id").collect():  # one file's content
        low, high = RANGES.get(r.band, (None, None))
        bounds = {"min_sloc": low, "max_sloc": high} if r.kind == "file" else {}
        own = out.setdefault((r.kind, r.cohort, r.model, low or 0), {"kind": r.kind, "cohort": r.cohort, "model_id": names[r.model], **bounds, "distributions": []})
        own["distributions"].append({"metric_id": r.metric_id, "values": list(r["values"])})
    return [out[k] for k in sorted(out)]


def calibrate(spark: SparkSession, manifest: str | Path, cache: str | Path, folder: str | Path, *, language: str = "python") -> Path:
    """Scan every project of a corpus manifest (TOML: profile_id, min_samples, settings, projects with name, revision,
    license_file and patterns), each in its own verified folder, and write the profile beside a copy of the manifest."""
    raw = Path(manifest).read_bytes()
    corpus, cache = tomllib.loads(raw.decode("utf-8")), Path(cache)
    base = replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in corpus.get("settings", {}).items()})
    roots = [(p, verified(cache, p)) for p in sorted(corpus["projects"], key=lambda p: p["name"])]
    if any(Path(folder).resolve().is_relative_to(root) for _, root in roots):
        raise ValueError("a profile is not written into its own corpus")
    found = provenance = None
    for project, root in roots:
        own = replace(base, **{k: tuple(project[k]) for k in ("production_patterns", "test_patterns", "exclusions") if k in project})
        snapshot = Snapshot(read_directory(spark, str(root), own.exclusions, languages={language}), own)
        provenance = snapshot.provenance
        rows = observations(snapshot, project["name"])
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("a corpus has at least one project")
    profile = {
        "schema_version": "1.0", "profile_id": corpus["profile_id"], "language": language, "rule_set_version": provenance["rule_set_version"],
        "clone_normalization_version": provenance["clone_normalization_version"], "metric_versions": [{"metric_id": k, "version": v} for k, v in sorted(provenance["metric_versions"].items())],
        "settings": {k: _plain(provenance["settings"][k]) for k in MEASURING}, "populations": populations(found, corpus.get("min_samples", 5)),
        "score_models": DEFAULT_MODELS, "bands": DEFAULT_BANDS, "corpus_sha256": hashlib.sha256(raw).hexdigest(),
    }
    return save_profile(folder, profile, raw)
