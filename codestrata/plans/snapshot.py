"""One source state: from an inventory to evidence, metrics and scores.

The files are parsed once, in one pass; its result is written down in the shared folder, and everything else is relational.
"""

from __future__ import annotations

from dataclasses import fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..extract import clone_runs, complexity, families, rules
from ..functions.fingerprints import content_hash, token_fingerprint
from ..operators import clones, coverage, ratios, scoring
from ..operators.lines import span_lines
from ..session import shared_dir

FILE = ["path", "language", "cohort"]
SCORED = ["verbosity.patterns", "verbosity.clones", "verbosity.combined", "erosion"]


#: Versions of what the metrics mean.
METRIC_VERSIONS = {"verbosity.patterns": "1", "verbosity.clones": "1", "verbosity.combined": "1", "erosion": complexity.COMPLEXITY_VERSION}
#: Settings that change what is measured.
MEASURING = ("clone_min_statements", "clone_min_sloc", "complexity_threshold", "enabled_rules", "disabled_rules")


class StrictFailure(RuntimeError):
    """The first error of a scan in strict mode."""


class Snapshot:
    """Tables of one source state.  ``inventory`` is what ``sources`` gives."""

    def __init__(self, inventory: DataFrame, config: Config = Config()):
        self.config, self.spark = config, inventory.sparkSession
        shared_dir(self.spark)
        self.inventory = coverage.classify(inventory, production=list(config.production_patterns), test=list(config.test_patterns), exclusions=list(config.exclusions), markers=list(config.generated_markers))
        if config.strict and (bad := self.diagnostics.filter("severity = 'error'").orderBy("path", "code").first()):
            raise StrictFailure(f"{bad.path}: {bad.code}: {bad.message}")

    @cached_property
    def provenance(self) -> dict:
        """How this state was analyzed: versions, and all settings."""
        settings = {f.name: getattr(self.config, f.name) for f in fields(self.config)}
        versions = {"rule_set_version": rules.RULE_SET_VERSION, "clone_normalization_version": clone_runs.NORMALIZATION_VERSION, "metric_versions": METRIC_VERSIONS}
        return versions | {"settings": {k: sorted(v) if k.endswith("_rules") else v for k, v in settings.items()}}

    @cached_property
    def documents(self) -> DataFrame:
        return self.inventory.filter("state = 'scored'").select(*FILE, "content")

    @cached_property
    def evidence(self) -> DataFrame:
        rules = {"enabled_rules": list(self.config.enabled_rules) or None, "disabled_rules": list(self.config.disabled_rules) or None}
        runs = {"clone_min_statements": self.config.clone_min_statements, "clone_min_sloc": self.config.clone_min_sloc}
        hashed = self.documents.withColumn("source_sha256", content_hash(F.col("content")))
        return families.extract(hashed, **rules, **runs).checkpoint()

    @cached_property
    def files(self) -> DataFrame:
        """path, language, cohort, sloc, parse_state, source_sha256, failure."""
        rows = self.evidence.select(*FILE, "sloc", "parse_state", "source_sha256", F.col("diagnostic.code").alias("_code"))
        unread = self.inventory.filter("state = 'failed'").select(*FILE, F.lit(0).alias("sloc"), F.lit("failed").alias("parse_state"), F.lit(None).cast("string").alias("source_sha256"), F.lit("source.read-error").alias("_code"))
        return rows.unionByName(unread).withColumn("failure", F.when(F.col("parse_state") == "failed", F.col("_code"))).drop("_code")

    @cached_property
    def lines(self) -> DataFrame:
        return families.sloc_lines(self.evidence, FILE)

    def family(self, name: str) -> DataFrame:
        return families.family(self.evidence, name, [*FILE, "source_sha256"])

    @cached_property
    def diagnostics(self) -> DataFrame:
        read = self.inventory.filter("read_error IS NOT NULL AND state = 'failed'").select(
            *FILE, F.lit("error").alias("severity"), F.lit("source.read-error").alias("code"), F.col("read_error").alias("message"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")
        )
        return families.diagnostics(self.evidence, FILE).unionByName(read)

    @cached_property
    def coverage(self) -> DataFrame:
        sloc = self.evidence.select("path", "sloc")
        return coverage.coverage_counts(self.inventory.select("path", "state", "cohort", "language", "reason").join(sloc, "path", "left"))

    def failed(self, family: str) -> DataFrame:
        """Files in which one family's analysis failed."""
        hit = F.exists("failed_families", lambda f: f.family == family)
        return self.evidence.filter(hit).select("path", F.lit("analyzer-failed").alias("reason"))

    @cached_property
    def candidates(self) -> DataFrame:
        return self.family("clones").withColumn("fingerprint", token_fingerprint(F.col("tokens"))).drop("tokens")

    @cached_property
    def clone_members(self) -> DataFrame:
        groups = clones.clone_groups(self.candidates)
        return clones.without_contained(clones.clone_members(self.candidates, groups)).checkpoint()

    @cached_property
    def flagged_lines(self) -> DataFrame:
        return span_lines(self.family("findings").select("path", "start_line", "end_line"), self.lines, ["path"]).select("path", "line").distinct()

    @cached_property
    def cloned_lines(self) -> DataFrame:
        return span_lines(self.clone_members.select("path", "start_line", "end_line"), self.lines, ["path"]).select("path", "line").distinct()

    def metrics(self, *, per_file: bool = False) -> DataFrame:
        """All four metrics, by population or by file; failures of one family leave the others standing."""
        no_patterns, no_clones = self.failed("findings"), self.failed("clones")
        rows = ratios.line_ratio(self.files, self.flagged_lines, "verbosity.patterns", per_file=per_file, failed=no_patterns)
        rows = rows.unionByName(ratios.line_ratio(self.files, self.cloned_lines, "verbosity.clones", per_file=per_file, failed=no_clones))
        rows = rows.unionByName(ratios.combined_ratio(self.files, self.flagged_lines, self.cloned_lines, per_file=per_file, failed_patterns=no_patterns, failed_clones=no_clones))
        return rows.unionByName(ratios.erosion(self.files, self.family("functions"), threshold=self.config.complexity_threshold, per_file=per_file))

    def scores(self, profile: Profile | None, *, per_file: bool = False, profile_error: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Scores (points, band, reason) and the contributions of their metrics.  ``profile_error``: why a profile that was
        asked for could not be loaded."""
        return score_metrics(self.metrics(per_file=per_file), self.files, profile, self.provenance, per_file=per_file, profile_error=profile_error)


class Profile:
    """A calibration profile: populations (kind, cohort, model, min_sloc, max_sloc, metric_id, values), the metrics of each
    model (model, metric_id, weight, transform), and bands.  ``identity`` says what analyses it fits: language, versions and
    settings; without one it fits any.  A profile comes from one file, so its tables are small enough to be broadcast."""

    def __init__(self, populations: DataFrame, models: list[tuple[str, str, float, str]], bands: list[tuple[str, float]], identity: dict | None = None):
        weights: dict[str, float] = {}
        for model, _, weight, _ in models:
            weights[model] = weights.get(model, 0) + weight
        if any(abs(w - 1) > 1e-9 for w in weights.values()):
            raise ValueError("weights of a model must sum to 1")
        lower = [b for _, b in bands]
        if not lower or lower[0] != 0 or lower != sorted({*lower}):
            raise ValueError("bands must start at 0 and increase")
        self.populations, self.models, self.bands, self.identity = populations, models, bands, identity

    @classmethod
    def of(cls, spark: SparkSession, document: dict) -> Profile:
        """From a profile's document, as ``sources.reports.load_profile`` gives it."""
        names = {m["model_id"]: MODELS[m["eligibility"]] for m in document["score_models"]}
        if len({*names.values()}) < len(names):
            raise ValueError("a profile has one model for each kind of scope")
        rows, taken = [], {}
        for p in document["populations"]:
            if p["model_id"] not in names:
                raise ValueError(f"population of an unknown model: {p['model_id']}")
            bounds, key = (p.get("min_sloc"), p.get("max_sloc")), (p["kind"], p["cohort"], p["model_id"])
            for low, high in taken.get(key, []):
                if (high is None or (bounds[0] or 0) < high) and (bounds[1] is None or (low or 0) < bounds[1]):
                    raise ValueError(f"populations of {key} overlap")
            taken.setdefault(key, []).append(bounds)
            for d in p["distributions"]:
                if not d["values"] or d["values"] != sorted(d["values"]):
                    raise ValueError("values of a population must be sorted")
                rows.append((p["kind"], p["cohort"], names[p["model_id"]], *bounds, d["metric_id"], [float(v) for v in d["values"]]))
        models = [(names[m["model_id"]], i["metric_id"], float(i["weight"]), i.get("transform", "percentile")) for m in document["score_models"] for i in m["inputs"]]
        populations = spark.createDataFrame(rows, "kind string, cohort string, model string, min_sloc int, max_sloc int, metric_id string, values array<double>")
        identity = {k: document[k] for k in ("language", "rule_set_version", "clone_normalization_version", "settings")} | {"metric_versions": {v["metric_id"]: v["version"] for v in document["metric_versions"]}}
        return cls(populations, models, [(b["label"], float(b["lower"])) for b in document["bands"]], identity)


#: Eligibility of a profile's model -> the model of a scope.
MODELS = {"all-metrics": "full", "no-functions": "verbosity-only"}


def mismatches(identity: dict | None, provenance: dict) -> list[str]:
    """What of a profile's identity, its language aside, an analysis does not share."""
    if identity is None:
        return []
    out = [k for k in ("rule_set_version", "clone_normalization_version") if identity[k] != provenance[k]]
    out += [f"settings.{k}" for k in MEASURING if _plain(identity["settings"].get(k, getattr(Config, k))) != _plain(provenance["settings"][k])]
    return out + [f"metric_versions.{k}" for k, v in sorted(identity["metric_versions"].items()) if provenance["metric_versions"].get(k) != v]


def _plain(value: object) -> object:
    return sorted(value) if isinstance(value, (list, tuple, set)) else value


def score_metrics(metrics: DataFrame, files: DataFrame, profile: Profile | None, provenance: dict, *, per_file: bool, profile_error: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points, band or reason of each scope (F1-F6), and its contributions."""
    keys = [*FILE] if per_file else ["language", "cohort"]
    scopes = metrics.select(*keys).distinct().join(files.groupBy(*keys).agg(F.sum("sloc").alias("sloc")), keys, "left").na.fill(0, ["sloc"])
    scopes = scopes.join(scoring.model_of(metrics.select(*keys, "metric_id", "state", "reason")), keys, "left")
    spark, error = metrics.sparkSession, F.lit(profile_error).cast("string")
    if profile is None:
        # What a score would need is told before the want of a profile.
        earlier = F.when(~F.col("model").eqNullSafe(F.lit("full")), "required-metric-unavailable")
        reason = scoring.score_state(F.col("sloc"), error, F.lit(False), F.lit(True), earlier, F.col("model"), F.lit(False))
        out = scopes.select(*keys, "sloc", "model", F.lit(None).cast("decimal(5,1)").alias("points"), F.lit(None).cast("string").alias("band"), reason.alias("reason"))
        return out, spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", metric_id string, raw double, percentile decimal(20,10), weight double, transform string, points decimal(5,1)")
    fits = F.lit(not mismatches(profile.identity, provenance))
    if profile.identity is not None:
        fits = fits & (F.col("language") == profile.identity["language"])
    scopes = scopes.withColumn("_fits", fits)
    models = spark.createDataFrame(profile.models, "model string, metric_id string, weight double, transform string")
    kind = "file" if per_file else "project"
    wanted = scopes.filter("model IS NOT NULL AND _fits").join(F.broadcast(models), "model")
    raw = metrics.filter("state = 'measured'").select(*keys, "metric_id", F.col("value").alias("raw"))
    wanted = wanted.join(raw, [*keys, "metric_id"]).withColumn("kind", F.lit(kind))
    placed = scoring.with_population(wanted.select(*keys, "kind", "model", "metric_id", "weight", "transform", "sloc", "raw"), profile.populations, ["kind", "cohort", "model", "metric_id"])
    ranked = placed.withColumn("percentile", F.when(F.col("values").isNotNull(), scoring.percentile(F.col("values"), F.col("raw"))))
    whole = ranked.groupBy(*keys).agg(F.bool_and(F.col("values").isNotNull()).alias("_all"))
    parts = scoring.contributions(ranked.join(whole.filter("_all"), keys), keys).select(*keys, "metric_id", "raw", "percentile", "weight", "transform", "points")
    totals = parts.groupBy(*keys).agg(F.sum("points").cast("decimal(5,1)").alias("points"))
    rows = scopes.join(totals, keys, "left").join(whole, keys, "left")
    reason = scoring.score_state(F.col("sloc"), error, F.lit(True), F.col("_fits"), F.lit(None).cast("string"), F.col("model"), F.coalesce("_all", F.lit(False)))
    rows = rows.withColumn("reason", reason).withColumn("points", F.when(F.col("reason").isNull(), F.col("points")))
    scored = rows.filter("reason IS NULL").select(*keys)
    return rows.select(*keys, "sloc", "model", "points", scoring.band_of(F.col("points"), profile.bands).alias("band"), "reason"), parts.join(scored, keys, "left_semi")
