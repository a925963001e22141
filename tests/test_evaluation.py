"""Evaluation on pinned cases, look-ups, the contract of extractors, and text reports."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from codestrata import cli
from codestrata.extract import families
from codestrata.operators import checks, evidence, ranking
from codestrata.plans import evaluation


def manifest(tmp_path, cases):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"cases": cases}))
    return path


def blob(tmp_path, content):
    digest = hashlib.sha256(content).hexdigest()
    (tmp_path / digest).write_bytes(content)
    return digest


def test_pointers_and_strict_json():
    document = {"a/b": [{"~": 1}, {"": None}], "01": {"0": True}}
    assert evaluation.at(document, "/a~1b/0/~0") == 1 and evaluation.at(document, "/a~1b/1/") is None and evaluation.at(document, "") is document and evaluation.at(document, "/01/0") is True
    for nowhere in ("/a", "/a~1b/2", "/a~1b/00", "/a~1b/-", "/01/0/x"):
        with pytest.raises(evaluation.Missing):
            evaluation.at(document, nowhere)
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[1e999]", "[Infinity]"):
        with pytest.raises(ValueError, match="."):
            evaluation.strict_json(bad)
    assert evaluation.same([1, {"a": True}], [1.0, {"a": True}]) and not evaluation.same(True, 1) and not evaluation.same([1], [1, 2])


def test_evaluation_tells_differences_from_failures(tmp_path):
    digest, seen = blob(tmp_path, b"x = 1\n"), []

    def run(arguments, root, seconds):
        seen.append((arguments, sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file())))
        if arguments == ["broken"]:
            raise RuntimeError("no report")
        return '{"scores": [{"sloc": 1}]}'

    good = {"name": "good", "arguments": ["scan"], "files": {"lib/a.py": digest}, "expect": {"/scores/0/sloc": 1}}
    assert evaluation.evaluate(manifest(tmp_path, [good]), tmp_path, run=run) == (0, [{"case": "good", "pointer": "/scores/0/sloc", "state": "pass", "found": 1}])
    assert seen == [(["scan"], ["lib/a.py"])]
    other = good | {"name": "other", "expect": {"/scores/0/sloc": 2, "/none": 1}}
    code, results = evaluation.evaluate(manifest(tmp_path, [good, other]), tmp_path, run=run)
    assert code == 1 and [r["state"] for r in results] == ["pass", "fail", "fail"]
    code, results = evaluation.evaluate(manifest(tmp_path, [good | {"arguments": ["broken"]}, other, good | {"name": "lost", "files": {"a.py": "0" * 64}}]), tmp_path, run=run)
    assert code == 2 and [r["state"] for r in results] == ["error", "fail", "fail", "error"]
    for bad in ({"files": {"../a": digest}}, {"files": {"a": "xyz"}}, {"expect": {}}, {"more": 1}):
        with pytest.raises(ValueError, match="."):
            evaluation.load_cases(manifest(tmp_path, [good | bad]))


def test_look_ups_want_one_row(spark):
    files = spark.createDataFrame([("a.py", 1), ("b.py", 2), ("b.py", 3)], "path string, sloc int")
    assert evidence.file_row(files, "a.py").sloc == 1
    for path, why in (("c.py", "not found"), ("b.py", "ambiguous")):
        with pytest.raises(evidence.LookupFailure, match=why):
            evidence.file_row(files, path)
    pairs = spark.createDataFrame([("a.py", "b.py", "renamed"), ("c.py", None, "deleted"), (None, "a.py", "added")], "baseline_path string, current_path string, kind string")
    assert [evidence.change_row(pairs, p).kind for p in ("a.py", "b.py", "c.py")] == ["added", "renamed", "deleted"]
    functions = spark.createDataFrame([("a.py", "f"), ("a.py", "C.f")], "path string, qualified_name string")
    assert evidence.callable_row(functions, "a.py", "C.f").qualified_name == "C.f"
    members = spark.createDataFrame([("g", "a.py"), ("g", "b.py"), ("h", "b.py")], "group_id string, path string")
    found, groups = evidence.file_evidence(functions, members, "a.py")
    assert found.count() == 2 and sorted(tuple(r) for r in groups.collect()) == [("g", "a.py"), ("g", "b.py")]


def test_canonical_orders(spark):
    rows = [("python", c, "1", f, p, 1, 2) for c in ("test", "production") for f in "ba" for p in ("y", "x")]
    got = ranking.ordered_groups(spark.createDataFrame(rows, "language string, cohort string, normalization_version string, fingerprint string, path string, start_line int, end_line int"))
    assert [tuple(r) for r in got.collect()] == sorted(rows)
    changes = [("python", "production", p, n, s) for p in "ba" for n in (2, 1) for s in ("removed", "added")]
    assert [tuple(r) for r in ranking.ordered_symbols(spark.createDataFrame(changes, "language string, cohort string, path string, start_line int, state string")).collect()] == sorted(changes)


def test_extractors_are_held_to_what_they_declare(spark):
    parsed = {"parse_state": "parsed", "sloc": 2, "sloc_lines": [1, 2]}
    makers = {
        "plain": (lambda content, options: parsed, set()),
        "more": (lambda content, options: parsed | {"imports": [{"line": 1}]}, {"symbols"}),
        "mute": (lambda content, options: {"parse_state": "failed"}, set()),
    }
    try:
        for name, (maker, own) in makers.items():
            families.register(name, maker, own, (f".{name}",))
        with pytest.raises(ValueError, match="unknown families"):
            families.register("odd", makers["plain"][0], {"nothing"})
        documents = spark.createDataFrame([(f"a.{n}", bytearray(b""), n) for n in makers], "path string, content binary, language string")
        got = families.extract(documents)
        rows = {r.language: r for r in got.collect()}
        assert (rows["plain"].parse_state, rows["plain"].sloc, rows["plain"].imports) == ("parsed", 2, [])
        assert "undeclared" in rows["more"].diagnostic.message and "has a diagnostic" in rows["mute"].diagnostic.message
        assert rows["more"].diagnostic.code == "more.adapter-failed" and rows["more"].imports == []
        assert checks.uncovered_documents(documents, got, ["path"]).count() == 0
        short = checks.uncovered_documents(documents, got.filter("language <> 'mute'").union(got.filter("language = 'more'")), ["path"])
        assert sorted(r.path for r in short.collect()) == ["a.more", "a.mute"]
    finally:
        for name in makers:
            for table in (families.LANGUAGES, families.CAPABILITIES):
                table.pop(name, None)
            families.SUFFIXES.pop(f".{name}", None)


def test_reports_as_text(spark):
    rows = spark.createDataFrame([("python", "production", None, None, 7, "calibration-missing")] * 3, "language string, cohort string, points double, band string, sloc int, reason string")
    assert cli._text("scores", rows, 2).split("\n") == ["scores", *["  python/production: - - (7 source lines, calibration-missing)"] * 2, "  ..."]
    assert cli._text("scores", rows.select("sloc"), 5).split("\n")[:2] == ["scores", "  sloc"]
    assert cli._text("other", rows.select(F.lit(None).alias("x")).limit(1), 5) == "other\n  x\n  -"
