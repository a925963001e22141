"""Settings of an analysis and their sources (A10, B9, section 1.4 of the survey)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Defaults of a scan.  ``boundaries`` are (name, path prefix) pairs."""

    production_patterns: tuple[str, ...] = ("**/*.py",)
    test_patterns: tuple[str, ...] = ("tests/**/*.py", "**/test_*.py", "**/*_test.py")
    exclusions: tuple[str, ...] = (".git/**", ".venv/**", "venv/**", "**/__pycache__/**", "build/**", "dist/**")
    generated_markers: tuple[str, ...] = ("@generated", "Generated by")
    languages: tuple[str, ...] = ()
    enabled_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    clone_min_statements: int = 2
    clone_min_sloc: int = 6
    complexity_threshold: int = 10
    calibration_profile: str = "py-2026.3"
    default_hotspot_count: int = 5
    boundaries: tuple[tuple[str, str], ...] = ()
    strict: bool = False

    def __post_init__(self) -> None:
        if both := {*self.enabled_rules} & {*self.disabled_rules}:
            raise ValueError(f"rules both enabled and disabled: {sorted(both)}")
        for what, values in (("name", [n for n, _ in self.boundaries]), ("prefix", [p for _, p in self.boundaries])):
            if len({*values}) < len(values):
                raise ValueError(f"a boundary {what} occurs twice")
        for name in ("clone_min_statements", "clone_min_sloc", "complexity_threshold", "default_hotspot_count"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


def _checked(values: dict) -> dict:
    known = {f.name: f.type for f in fields(Config)}
    if unknown := {*values} - {*known}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {}
    for name, value in values.items():
        default = getattr(Config, name)
        if name == "boundaries":
            value = tuple((b["name"], b["prefix"]) if isinstance(b, dict) else tuple(b) for b in value)
        elif isinstance(default, tuple):
            value = tuple(value)
        elif type(value) is not type(default):
            raise ValueError(f"{name} must be of type {type(default).__name__}")
        out[name] = value
    return out


def load_config(root: Path | None = None, *, explicit: Path | None = None, tool: str = "codestrata", **overrides: object) -> Config:
    """Settings of ``pyproject.toml`` (its table ``[tool.TOOL]``), then of ``TOOL.toml``, then ``overrides``; a file given
    explicitly takes the place of both.  ``tool`` is a parameter, so that settings kept under another name still serve."""
    config = Config()
    if explicit is not None:
        config = replace(config, **_checked(tomllib.loads(explicit.read_text("utf-8"))))
    elif root is not None:
        project, own = root / "pyproject.toml", root / f"{tool}.toml"
        if project.exists():
            config = replace(config, **_checked(tomllib.loads(project.read_text("utf-8")).get("tool", {}).get(tool, {})))
        if own.exists():
            config = replace(config, **_checked(tomllib.loads(own.read_text("utf-8"))))
    return replace(config, **_checked({k: v for k, v in overrides.items() if v is not None}))


def load_limits(path: Path) -> dict[str, int]:
    """A change budget: the table ``[budget]`` of a TOML file, metric by metric."""
    values = tomllib.loads(path.read_text("utf-8")).get("budget")
    if not isinstance(values, dict) or not values:
        raise ValueError("a budget file has a table [budget] with limits")
    if bad := [k for k, v in values.items() if type(v) is not int or v < 0]:
        raise ValueError(f"limits must be whole numbers of 0 or more: {sorted(bad)}")
    return values


def load_policy(path: Path) -> tuple[list[str], list[tuple[str, str]]]:
    """An architecture policy: ``source_roots``, and ``[[forbidden]]`` tables of a source and a target."""
    data = tomllib.loads(path.read_text("utf-8"))
    if unknown := {*data} - {"source_roots", "forbidden"}:
        raise ValueError(f"unknown keys of a policy: {sorted(unknown)}")
    rules = [(r["source"], r["target"]) for r in data.get("forbidden", [])]
    for name in (x for rule in rules for x in rule):
        if not all(part.isidentifier() for part in name.split(".")):
            raise ValueError(f"not a module name: {name}")
    return list(data.get("source_roots", ["."])), rules
