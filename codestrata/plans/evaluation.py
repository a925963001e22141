"""Evaluation on pinned cases: sources by their hashes, a command on them, and values expected at places of its report."""

from __future__ import annotations

import hashlib
import json
import math
import subprocess
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path, PurePosixPath


class Missing(LookupError):
    """A pointer leads nowhere."""


def strict_json(text: str) -> object:
    """JSON without repeated keys and without numbers that are not finite."""

    def members(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key occurs twice")
        return out

    def number(text: str) -> float:
        if not math.isfinite(value := float(text)):
            raise ValueError(f"not a finite number: {text}")
        return value

    return json.loads(text, object_pairs_hook=members, parse_float=number, parse_constant=number)


def at(document: object, pointer: str) -> object:
    """The value that a JSON pointer (RFC 6901) leads to."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a pointer: {pointer}")
    for token in pointer.split("/")[1:]:
        key = token.replace("~1", "/").replace("~0", "~")
        if isinstance(document, dict) and key in document:
            document = document[key]
        elif isinstance(document, list) and key.isdecimal() and (key == "0" or key[0] != "0") and int(key) < len(document):
            document = document[int(key)]
        else:
            raise Missing(pointer)
    return document


def same(a: object, b: object) -> bool:
    """Equality of JSON values, in which true is not 1; lists and objects member by member."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def load_cases(path: str | Path) -> list[dict]:
    """Cases of a manifest: name, arguments, files (path to hash) and expect (pointer to value)."""
    data = strict_json(Path(path).read_text("utf-8"))
    cases = data.get("cases") if isinstance(data, dict) else None
    if not isinstance(cases, list) or not cases:
        raise ValueError("a manifest has a list of cases")
    for case in cases:
        if not isinstance(case, dict) or {*case} != {"name", "arguments", "files", "expect"}:
            raise ValueError("a case has a name, arguments, files and what to expect")
        for name, digest in case["files"].items():
            pure = PurePosixPath(name)
            if pure.is_absolute() or ".." in pure.parts or not name or "\0" in name or "\\" in name:
                raise ValueError(f"not a path inside the case: {name}")
            if len(digest) != 64 or {*digest} - {*"0123456789abcdef"}:
                raise ValueError(f"not a hash: {digest}")
        if not case["expect"]:
            raise ValueError(f"{case['name']} expects nothing")
    if len({c["name"] for c in cases}) < len(cases):
        raise ValueError("two cases have one name")
    return cases


def materialize(files: dict[str, str], blobs: Path, root: Path) -> None:
    """Write each file from the blob named by its hash, after checking the hash."""
    for name, digest in files.items():
        content = (blobs / digest).read_bytes()
        if hashlib.sha256(content).hexdigest() != digest:
            raise ValueError(f"blob {digest} has another hash")
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def run_command(arguments: list[str], root: Path, seconds: float) -> str:
    """The JSON report of a command on a folder, from a process of its own that is ended after some time."""
    command = [sys.executable, "-m", "codestrata.cli", *arguments, "--root", str(root), "--json"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=seconds)
    if done.returncode not in (0, 1):
        raise RuntimeError(done.stderr.strip()[-500:] or f"exit {done.returncode}")
    return done.stdout


def evaluate(manifest: str | Path, blobs: str | Path, *, seconds: float = 300, run: Callable[[list[str], Path, float], str] = run_command) -> tuple[int, list[dict]]:
    """Exit code (0: all as expected, 1: some differ, 2: some could not be judged) and one result for each expectation."""
    out = []
    for case in load_cases(manifest):
        try:
            with tempfile.TemporaryDirectory() as folder:
                materialize(case["files"], Path(blobs), Path(folder))
                report = strict_json(run(case["arguments"], Path(folder), seconds))
        except (OSError, ValueError, RuntimeError, subprocess.TimeoutExpired) as error:
            out.append({"case": case["name"], "pointer": None, "state": "error", "found": f"{type(error).__name__}: {error}"})
            continue
        for pointer, wanted in case["expect"].items():
            try:
                found = at(report, pointer)
                out.append({"case": case["name"], "pointer": pointer, "state": "pass" if same(found, wanted) else "fail", "found": found})
            except Missing:
                out.append({"case": case["name"], "pointer": pointer, "state": "fail", "found": None})
    states = {r["state"] for r in out}
    return (2 if "error" in states else 1 if "fail" in states else 0), out
