"""Saved reports, profiles and ledgers.

Reports are assembled on the driver for people and other tools; they are never a working representation.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

EVENT = (
    "sequence int, review_id string, kind string, language string, cohort string, symbol string, actor string, recorded_at string, evidence_fingerprint string, source_hashes array<string>, "
    "boundary string, analysis_fingerprint string, disposition string, reason string, next_step string, supersedes_legacy_id string"
)
EXPERIMENTS = {"py-error-fallback-1": "errors", "py-coupled-state-1": "models", "py-variant-review-1": "variants", "py-derived-state-1": "derived"}
_PROFILE_ID = re.compile(r"[a-z0-9]+(-[a-z0-9.]+)+")


def to_json(report: object) -> str:
    """Sorted keys, two spaces, a last line end."""
    return json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def as_report(tables: dict[str, DataFrame], **facts: object) -> dict:
    """A report of small result tables, each in the order of its columns.  All rows are complete; limits are for display."""
    out: dict[str, object] = {"schema_version": "1.0", **facts}
    for name, df in tables.items():
        rows = [json.loads(r) for r in df.toJSON().collect()]
        out[name] = sorted(rows, key=lambda r: json.dumps(r, sort_keys=True))
    return out


def load_report(path: str | Path) -> tuple[str, dict]:
    """Kind and content of a saved report, told by its experiment."""
    data = json.loads(Path(path).read_text("utf-8"))
    if "experiment" in data:
        if data["experiment"] not in EXPERIMENTS:
            raise ValueError(f"unknown experiment: {data['experiment']}")
        return EXPERIMENTS[data["experiment"]], data
    return "snapshot", data


def load_profile(folder: str | Path, profile_id: str) -> dict:
    """A profile whose id matches its name, and whose manifest has the hash that the profile names."""
    if not _PROFILE_ID.fullmatch(profile_id):
        raise ValueError(f"bad profile id: {profile_id}")
    data = json.loads(Path(folder, f"{profile_id}.json").read_text("utf-8"))
    digest = hashlib.sha256(Path(folder, f"{profile_id}.corpus.toml").read_bytes()).hexdigest()
    if data.get("profile_id") != profile_id or data.get("corpus_sha256") != digest:
        raise ValueError(f"profile {profile_id} does not match its id or manifest")
    return data


def save_profile(folder: str | Path, profile: dict, manifest: bytes) -> Path:
    """Manifest first, the profile last, so that a profile never stands without its manifest."""
    folder = Path(folder)
    Path(folder, f"{profile['profile_id']}.corpus.toml").write_bytes(manifest)
    path = folder / f"{profile['profile_id']}.json"
    _replace(path, to_json(profile | {"corpus_sha256": hashlib.sha256(manifest).hexdigest()}))
    return path


def _replace(path: Path, text: str) -> None:
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def load_ledger(path: str | Path) -> dict:
    """Events and legacy decisions; a ledger of version 1 has only the latter."""
    if not Path(path).exists():
        return {"schema_version": "2", "events": [], "legacy_decisions": []}
    data = json.loads(Path(path).read_text("utf-8"))
    if data.get("schema_version", "1") == "1":
        return {"schema_version": "2", "events": [], "legacy_decisions": data.get("decisions", [])}
    return data


def append_event(path: str | Path, event: dict) -> dict:
    """The ledger with one more event under the next number: one writer at a time, replaced as a whole."""
    path = Path(path)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        ledger = load_ledger(path)
        last = max((e["sequence"] for e in ledger["events"]), default=0)
        ledger["events"].append(event | {"sequence": last + 1})
        _replace(path, to_json(ledger))
    return ledger


def events_table(spark: SparkSession, ledger: dict) -> DataFrame:
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in ledger["events"]], EVENT)
