"""Whole plans on small source trees: scans, comparisons, architecture and history."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codestrata import api
from codestrata.config import Config, load_config
from codestrata.plans.snapshot import Profile, StrictFailure
from codestrata.sources import files, git

BLOCK = "def {name}({p}):\n    a = {p} + 1\n    b = a * 2\n    c = b - 3\n    d = c\n    e = d\n    return e\n"


def tree(root, contents):
    for path, text in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture
def project(tmp_path):
    return tree(
        tmp_path,
        {
            "a.py": BLOCK.format(name="f", p="x"),
            "b.py": BLOCK.format(name="g", p="y"),
            "tests/test_a.py": BLOCK.format(name="h", p="z") + "v = True if f() else False\n",
            "README.md": "docs",
            "build/out.py": "x = 1\n",
            "gen.py": "# @generated\nx = 1\n",
        },
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan_measures_populations_apart(spark, project):
    snap = api.scan(spark, project)
    assert rows(snap.coverage, "state", F.coalesce("reason", F.lit("")), "file_count") == [("excluded", "generated", 1), ("scored", "", 1), ("scored", "", 2), ("unsupported", "unsupported", 1)]
    got = {(r.cohort, r.metric_id): r for r in snap.metrics().collect()}
    assert (got["production", "verbosity.clones"].numerator, got["production", "verbosity.clones"].denominator) == (12, 14)
    assert got["test", "verbosity.clones"].numerator == 0  # its copies are production's
    assert got["test", "verbosity.patterns"].value == pytest.approx(2 / 8)  # the conditional, and the block's last binding
    assert got["production", "erosion"].value == 0
    again = api.scan(spark, project)
    again.evidence = again.evidence.repartition(3)
    assert rows(again.metrics(), "cohort", "metric_id", "value") == rows(snap.metrics(), "cohort", "metric_id", "value")


def test_a_failed_file_voids_its_population_only(spark, tmp_path):
    snap = api.scan(spark, tree(tmp_path, {"a.py": "x = 1\n", "bad.py": "def f(:\n", "tests/test_a.py": "def t():\n    assert 1\n"}))
    state = {(r.cohort, r.metric_id): (r.state, r.reason) for r in snap.metrics().collect()}
    assert state["production", "erosion"] == ("unavailable", "python.parse-error")
    assert state["test", "erosion"] == ("measured", None)
    per_file = {(r.path, r.metric_id): r.reason for r in snap.metrics(per_file=True).collect()}
    assert per_file["a.py", "erosion"] == "no-functions" and per_file["a.py", "verbosity.combined"] is None
    with pytest.raises(StrictFailure):
        api.scan(spark, str(tmp_path), config=Config(strict=True))


def test_scores_split_tenths_and_explain_their_absence(spark, project):
    snap = api.scan(spark, project)
    populations = spark.createDataFrame(
        [("project", c, "full", None, None, m, [0.0, 0.5, 0.9]) for c in ("production", "test") for m in ("verbosity.combined", "erosion")],
        "kind string, cohort string, model string, min_sloc int, max_sloc int, metric_id string, values array<double>",
    )
    profile = Profile(populations, [("full", "verbosity.combined", 0.5, "percentile"), ("full", "erosion", 0.5, "percentile"), ("verbosity-only", "verbosity.combined", 1.0, "percentile")], [("low", 0), ("moderate", 20), ("high", 70)])
    scores, parts = snap.scores(profile)
    got = {r.cohort: r for r in scores.collect()}
    assert (float(got["production"].points), got["production"].band, got["production"].reason) == (33.3, "moderate", None)
    assert {(r.cohort, r.metric_id): float(r.points) for r in parts.collect()}["production", "verbosity.combined"] == 33.3
    assert {r.reason for r in snap.scores(None)[0].collect()} == {"calibration-missing"}
    with pytest.raises(ValueError, match="sum to 1"):
        Profile(populations, [("full", "erosion", 0.4, "percentile")], [("low", 0)])


def test_comparison_of_two_directories(spark, tmp_path):
    old = tree(tmp_path / "old", {"same.py": "x = 1\n", "old.py": "y = 2\n", "gone.py": "z = 3\n", "edit.py": '"doc"\nx = 1\n'})
    new = tree(tmp_path / "new", {"same.py": "x = 1\n", "new.py": "y = 2\n", "added.py": "q = 4\n", "edit.py": 'x = 0\n"doc"\nx = 1\n'})
    change = api.compare(spark, old, None, None, other_root=new)
    assert rows(change.pairs, "kind") == [("added",), ("deleted",), ("modified",), ("renamed",), ("unchanged",)]
    loc = change.loc().first()
    assert (loc.baseline_sloc, loc.current_sloc, loc.added, loc.deleted, loc.net, loc.growth) == (4, 6, 3, 1, 2, 0.5)
    assert [r.added for r in change.line_deltas.filter("current_path = 'edit.py'").collect()] == [[1, 2]]
    assert all(r.state in ("measured", "unavailable") for r in change.metric_deltas().collect())


def test_finding_and_symbol_continuity(spark, tmp_path):
    base = "def f(c):\n    v = True if c else False\n    return v, 1\ndef g():\n    return 1\ndef gone():\n    return 2\n"
    old = tree(tmp_path / "old", {"a.py": base, "m.py": "def stay():\n    return 3\n"})
    new = tree(tmp_path / "new", {"a.py": "\n\n" + base.replace("return 1\n", "return 11\n").replace("gone", "came") + "w = False if f else True\n", "m.py": "def stay():\n    return 3\n"})
    change = api.compare(spark, old, None, None, other_root=new)
    assert rows(change.finding_changes(), "state") == [("introduced",), ("persisted",)]
    got = change.symbol_changes()
    assert rows(got, "state") == [("modified",), ("unchanged",), ("unchanged",), ("unresolved",), ("unresolved",)]
    assert {r.reason for r in got.filter("state = 'unresolved'").collect()} == {"possible-declaration-rename"}
    checks, whole = api.evaluate_budget(change, {"findings": 0, "errors": 0, "clones": 0})
    assert {r.metric: r.state for r in checks.collect()} == {"findings": "exceeded", "errors": "pass", "clones": "pass"} and whole.first().state == "exceeded"
    counts = {r.state: r.n for r in change.review()["findings"].collect()}
    assert counts == {"introduced": 1, "persisted": 1, "removed": 0, "changed": 0, "unresolved": 0}


def clone_states(change):
    return rows(change.clone_changes(), "before", "after", "modified", "added", "removed", "unresolved", "state")


def test_edited_duplicates_stay_related(spark, tmp_path):
    old = tree(tmp_path / "old", {f"{n}.py": BLOCK.format(name="f", p="x") for n in "ab"})
    new = tree(tmp_path / "new", {f"{n}.py": BLOCK.format(name="f", p="x").replace("c = b - 3", "c = b - 4") for n in "ab"})
    change = api.compare(spark, old, None, None, other_root=new)
    assert {r.relation for r in change.member_relations().collect()} == {"anchored"}
    assert {r.resolution for r in change.group_resolution().collect()} == {"paired"}
    assert clone_states(change) == [(2, 2, 2, 0, 0, 0, "changed")]
    more = tree(tmp_path / "more", {f"{n}.py": BLOCK.format(name="f", p="x") for n in "abc"})
    assert clone_states(api.compare(spark, old, None, None, other_root=more)) == [(2, 3, 0, 1, 0, 0, "expanded")]
    none = tree(tmp_path / "none", {"a.py": BLOCK.format(name="f", p="x")})
    assert clone_states(api.compare(spark, old, None, None, other_root=none)) == [(2, 1, 0, 0, 1, 0, "removed")]
    assert clone_states(api.compare(spark, none, None, None, other_root=old)) == [(1, 2, 0, 1, 0, 0, "introduced")]


def test_duplicates_in_one_file(spark, tmp_path):
    pair = BLOCK.format(name="f", p="x") + "\n" + BLOCK.format(name="g", p="y")
    old = tree(tmp_path / "old", {"a.py": pair})
    assert clone_states(api.compare(spark, old, None, None, other_root=old)) == [(2, 2, 0, 0, 0, 0, "persisted")]
    shifted = tree(tmp_path / "shifted", {"a.py": "\n\n" + pair})
    assert clone_states(api.compare(spark, old, None, None, other_root=shifted)) == [(2, 2, 0, 0, 0, 0, "persisted")]
    third = tree(tmp_path / "third", {"a.py": pair + "\n" + BLOCK.format(name="h", p="z")})
    assert clone_states(api.compare(spark, old, None, None, other_root=third)) == [(2, 3, 0, 1, 0, 0, "expanded")]
    # Rewritten throughout, in place: neither the same nor told apart.
    body = "def {n}(x):\n" + "".join(f"    q{i} = x ** {i + 7}\n" for i in range(6))
    rewritten = tree(tmp_path / "rewritten", {"a.py": body.format(n="f") + "\n" + body.format(n="g")})
    assert {r.state for r in api.compare(spark, old, None, None, other_root=rewritten).clone_changes().collect()} == {"unresolved"}


def test_unassessed_counterparts_keep_members_unresolved(spark, tmp_path):
    old = tree(tmp_path / "old", {f"{n}.py": BLOCK.format(name="f", p="x") for n in "abc"})
    new = tree(tmp_path / "new", {f"{n}.py": BLOCK.format(name="f", p="x") for n in "ab"} | {"c.py": "def f(:\n"})
    change = api.compare(spark, old, None, None, other_root=new)
    assert clone_states(change) == [(3, 2, 0, 0, 0, 1, "unresolved")]
    checks, _ = api.evaluate_budget(change, {"clones": 9, "findings": 9})
    assert {r.metric: r.state for r in checks.collect()} == {"clones": "incomplete", "findings": "incomplete"}
    codes = {r.code for r in spark.read.json(change.blockers().select("detail").rdd.map(lambda r: r.detail)).collect()}
    assert {"python.parse-error", "unresolved-change"} <= codes


def symbol_states(spark, tmp_path, old, new):
    change = api.compare(spark, tree(tmp_path / "before", old), None, None, other_root=tree(tmp_path / "after", new))
    return rows(change.symbol_changes(), "state", F.coalesce("reason", F.lit("")))


def test_symbols_with_several_candidates_stay_unresolved(spark, tmp_path):
    same = "    return 1\n"
    names = lambda *n: "".join(f"def {x}():\n{same}" for x in n)
    assert symbol_states(spark, tmp_path / "1", {"a.py": names("one", "two")}, {"a.py": names("three", "four")}) == [("unresolved", "possible-declaration-rename")] * 4
    moved = symbol_states(spark, tmp_path / "2", {"a.py": "x = 1\n" + names("one")}, {"a.py": "x = 1\n", "b.py": names("one"), "c.py": "y = 1\n" + names("one")})
    assert moved == [("unresolved", "competing-move-candidates")] * 3
    assert symbol_states(spark, tmp_path / "3", {"a.py": "x = 1\n" + names("one")}, {"a.py": "x = 1\n", "b.py": "z = 1\n" + names("one")}) == [("moved", "")]
    assert symbol_states(spark, tmp_path / "4", {"a.py": "x = 1\n" + names("one")}, {"a.py": "x = 1\n", "b.py": "def one():\n    return 2\n"}) == [("unresolved", "possible-move-and-edit")] * 2
    assert symbol_states(spark, tmp_path / "5", {"a.py": names("one"), "b.py": "w = 1\n"}, {"a.py": "x = 1\n", "b.py": "def f(:\n"}) == [("unresolved", "counterpart-source-unavailable")]
    assert symbol_states(spark, tmp_path / "6", {"a.py": names("one")}, {"moved.py": names("one")}) == [("moved", "")]
    assert symbol_states(spark, tmp_path / "7", {"a.py": names("one", "one")}, {"a.py": names("one")}) == [("unresolved", "duplicate-qualified-name")] * 3


HANDLER = "def {name}(c):\n    try:\n        return c.{call}()\n    except OSError:\n        return {back}\n"


def error_states(spark, tmp_path, old, new):
    change = api.compare(spark, tree(tmp_path / "before", {"a.py": old}), None, None, other_root=tree(tmp_path / "after", {"a.py": new}))
    return rows(change.error_changes(), "state")


def test_error_handlers_are_matched_within_their_symbol(spark, tmp_path):
    one, two = HANDLER.format(name="one", call="read", back="[]"), HANDLER.format(name="two", call="load", back="None")
    plain = "def {}(c):\n    try:\n        return c.read()\n    except OSError:\n        raise\n"
    # A handler that goes in one symbol and one that comes in another are no pair.
    assert error_states(spark, tmp_path / "1", one + plain.format("two"), plain.format("one") + two) == [("introduced",), ("removed",)]
    assert error_states(spark, tmp_path / "2", one, "\n" + one) == [("persisted",)]
    assert error_states(spark, tmp_path / "3", one, one.replace("[]", "{}")) == [("changed",)]
    assert error_states(spark, tmp_path / "4", one, two) == [("unresolved",), ("unresolved",)]  # symbols vanish and appear
    assert error_states(spark, tmp_path / "5", one, one + two) == [("introduced",), ("persisted",)]
    unsure = one.replace("    except OSError:\n        return []", "    except OSError:\n        if c:\n            return []\n        return None")
    assert error_states(spark, tmp_path / "6", one, unsure) == [("unresolved",)]


def test_both_sides_need_the_same_settings(spark, project):
    from codestrata.plans.comparison import Comparison

    with pytest.raises(ValueError, match="settings"):
        Comparison(api.scan(spark, project), api.scan(spark, project, config=Config(clone_min_sloc=9)))


def test_calibration_gives_a_profile_that_scores(spark, tmp_path):
    from codestrata import cli
    from codestrata.plans.calibration import calibrate
    from codestrata.sources.reports import load_profile

    cache, revisions = tmp_path / "corpus", []
    for k, name in enumerate(("p", "q")):
        (cache / name).mkdir(parents=True)
        subprocess.run(["git", "init", "-q", str(cache / name)], check=True)
        revisions.append(commit(cache / name, 1, {"a.py": BLOCK.format(name="f", p="x") * (k + 1), "b.py": "x = 1\n", "LICENSE": "free"}))
    projects = "".join(f'[[projects]]\nname = "{n}"\nrevision = "{r}"\nlicense_file = "LICENSE"\n' for n, r in zip("pq", revisions, strict=True))
    manifest = tmp_path / "corpus.toml"
    manifest.write_text(f'profile_id = "own-1"\nmin_samples = 2\n{projects}')
    (tmp_path / "profiles").mkdir()
    calibrate(spark, manifest, cache, tmp_path / "profiles")
    document = load_profile(tmp_path / "profiles", "own-1")
    found = {(p["kind"], p["cohort"], p["model_id"], p.get("min_sloc"), d["metric_id"]): len(d["values"]) for p in document["populations"] for d in p["distributions"]}
    assert found["project", "production", "snapshot", None, "erosion"] == 2 and found["file", "production", "verbosity-only", 1, "verbosity.combined"] == 2
    profile = Profile.of(spark, document)
    scores, parts = api.scan(spark, str(cache / "p")).scores(profile)
    assert {(r.cohort, r.reason, r.points is not None, r.band) for r in scores.collect()} == {("production", None, True, "low"), ("test", "no-source-lines", False, None)} and parts.count() == 2
    assert {r.reason for r in api.scan(spark, str(cache / "p"), config=Config(clone_min_sloc=2)).scores(profile)[0].collect()} == {"calibration-incompatible", "no-source-lines"}
    assert {r.reason for r in api.scan(spark, str(cache / "p")).scores(profile, profile_error="calibration-invalid")[0].collect()} == {"calibration-invalid", "no-source-lines"}
    own = tmp_path / "settings.toml"
    own.write_text('calibration_profile = "own-1"\n')
    args = cli._parser().parse_args(["score", "--root", str(cache / "p"), "--config", str(own), "--profiles", str(tmp_path / "profiles")])
    assert {r.reason for r in cli.tables(args)["scores"].collect()} == {None, "no-source-lines"}
    (cache / "p" / "loose.py").write_text("y = 1\n")
    with pytest.raises(ValueError, match="changes"):
        calibrate(spark, manifest, cache, tmp_path / "profiles")


def test_scopes_without_functions_lack_a_metric_before_a_profile(spark, tmp_path):
    snap = api.scan(spark, tree(tmp_path, {"a.py": "x = 1\n", "tests/test_a.py": "def t():\n    assert 1\n"}))
    assert {r.cohort: r.reason for r in snap.scores(None)[0].collect()} == {"production": "required-metric-unavailable", "test": "calibration-missing"}


def test_review_targets_of_all_kinds_and_their_states(spark, tmp_path):
    from codestrata.operators import reviews
    from codestrata.plans.review import review_targets
    from codestrata.sources.reports import EVENT

    root = tree(tmp_path, {"a.py": BLOCK.format(name="f", p="x") + "v = True if f else False\n" + HANDLER.format(name="one", call="read", back="[]").replace("return c.read()", "r = c.read()").replace("return []\n", "return []\n    return r\n"), "lib/b.py": BLOCK.format(name="g", p="y")})
    config = Config(boundaries=(("library", "lib"), ("rest", "a.py")))
    present = review_targets(api.scan(spark, root, config=config)).collect()
    kinds = {r.kind for r in present}
    assert {"clone", "pattern", "complexity", "error"} <= kinds and all(r.unavailable is None for r in present)
    clone = next(r for r in present if r.kind == "clone")
    assert list(clone.paths) == ["a.py", "lib/b.py"] and clone.boundary == "library,rest" and len(clone.source_hashes) == 2
    names = [c.split()[0] for c in EVENT.split(", ")]
    event = {"sequence": 1, "review_id": clone.review_id, "kind": "clone", "language": "python", "cohort": "production", "disposition": "accepted", "evidence_fingerprint": clone.evidence_fingerprint, "source_hashes": clone.source_hashes, "boundary": clone.boundary, "analysis_fingerprint": clone.analysis_fingerprint}
    events = spark.createDataFrame([tuple(event.get(n) for n in names)], EVENT)
    state = lambda c: [(r.state, sorted(r.causes)) for r in reviews.resolve(events, review_targets(api.scan(spark, root, config=c)), "snapshot").collect()]
    assert state(config) == [("current", [])]
    assert state(Config(boundaries=(("library", "lib"),))) == [("stale", ["boundary"])]
    assert state(Config(boundaries=config.boundaries, clone_min_sloc=3)) == [("stale", ["analysis-definition"])]
    (tmp_path / "a.py").write_text((tmp_path / "a.py").read_text() + "w = 1\n")
    assert state(config) == [("stale", ["source"])]
    assert reviews.select_targets(review_targets(api.scan(spark, root)), kind="pattern", path="a.py").count() >= 1


def test_architecture(spark, tmp_path):
    root = tree(tmp_path, {"src/a.py": "import b\nimport b\nimport os\n", "src/b.py": "import a\n", "src/c.py": "from a import x\n", "src/pkg/__init__.py": "", "src/pkg/store.py": "", "src/pkg/ctl.py": "from . import store\nfrom . import nothing\nimport pkg.none\n"})
    got = api.inspect_architecture(spark, root, ["src"], [("pkg.ctl", "pkg.store"), ("a", "zzz")])
    assert rows(got["cycles"], "module", "cycle") == [("a", "a"), ("b", "a")]
    assert {r.module: r.fan_out for r in got["fan_out"].collect()} == {"a": 1, "b": 1, "c": 1, "pkg": 0, "pkg.ctl": 2, "pkg.store": 0}
    assert rows(got["violations"], "importer", "imported") == [("pkg.ctl", "pkg.store")]
    states = {(r.importer, r.expression): (r.state, r.reason) for r in got["imports"].collect()}
    assert states["a", "import os"] == ("external", None) and states["pkg.ctl", "import pkg.none"] == ("unresolved", "missing-internal")


def commit(root, day, contents, message="m"):
    tree(root, contents)
    stamp = f"{1_700_000_000 + day * 86_400} +0000"
    env = {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "e", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "e", "PATH": "/usr/bin:/bin", "HOME": str(root)}
    for args in (["add", "-A"], ["commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True, env=env)
    return subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture
def repo(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    return tmp_path


def test_commits_as_sources_and_history(spark, repo):
    first = commit(repo, 1, {"a.py": "original = 1\n", ".gitignore": "skip/\n"})
    second = commit(repo, 2, {"a.py": "original = 1\nnew_value = 2\n"})
    commit(repo, 3, {"a.py": "original = 1\nnew_value = 3\n"})
    tree(repo, {"skip/x.py": "y = 1\n", "loose.py": "z = 1\n"})
    assert rows(git.read_commit(spark, str(repo), second).filter("language = 'python'"), "path", F.col("content").cast("string")) == [("a.py", "original = 1\nnew_value = 2\n")]
    listed, left_out = files.list_files(repo)
    assert [r[0] for r in listed] == [".gitignore", "a.py", "loose.py"] and left_out == [("skip", "git ignored")]
    got = api.analyze_history(spark, str(repo), start=first)
    assert rows(got["rework"], "path", "line", "state", "age_seconds") == [("a.py", 2, "recent", 86_400)]
    total = got["totals"].filter("cohort = 'production'").first()
    assert (total.added, total.deleted, total.churn, total.net) == (2, 1, 3, 1)
    bounded = api.analyze_history(spark, str(repo), max_commits=1)
    assert [r.boundary for r in bounded["commits"].collect()] == ["commit-limit"]
    assert rows(bounded["rework"], "state", "reason") == [("unresolved", "unknown-introduction")]


def test_renames_are_hints(spark, repo):
    body = "".join(f"v{i} = {i}\n" for i in range(20))
    first = commit(repo, 1, {"a.py": body})
    (repo / "a.py").unlink()
    second = commit(repo, 2, {"b.py": body + "w = 1\n"})
    change = api.compare(spark, str(repo), first, second)
    assert rows(change.pairs, "baseline_path", "current_path", "kind") == [("a.py", "b.py", "renamed")]
    assert change.loc().first().net == 1


def test_config_sources(tmp_path):
    tree(tmp_path, {"pyproject.toml": "[tool.codestrata]\nclone_min_sloc = 4\nstrict = true\n", "codestrata.toml": "clone_min_sloc = 5\n", "own.toml": "complexity_threshold = 3\n"})
    merged = load_config(tmp_path, strict=False)
    assert (merged.clone_min_sloc, merged.strict, merged.complexity_threshold) == (5, False, 10)
    assert load_config(tmp_path, explicit=tmp_path / "own.toml").clone_min_sloc == 6
    for bad in ("nope = 1\n", "strict = 1\n", 'enabled_rules = ["x"]\ndisabled_rules = ["x"]\n'):
        tree(tmp_path, {"bad.toml": bad})
        with pytest.raises(ValueError, match="."):
            load_config(explicit=tmp_path / "bad.toml")
    assert files.resolve_languages(["Python", "py", ".pyi"]) == {"python"}
    with pytest.raises(ValueError, match="unknown"):
        files.resolve_languages(["cobol"])


def test_generated_workload_and_table_functions(spark):
    from codestrata.extract.udtf import register
    from codestrata.plans.workload import generated_inventory, scan_generated

    got = {(r.cohort, r.metric_id): r for r in scan_generated(spark, 3, 4).collect()}
    assert got["production", "erosion"].value == 0 and got["production", "verbosity.patterns"].denominator == 3 * 4 * 10
    register(spark)
    generated_inventory(spark, 2, 3).createOrReplaceTempView("tree")
    assert spark.sql("SELECT count(*) FROM tree, LATERAL py_functions(content)").first()[0] == 6
    assert spark.sql("SELECT count(*) FROM tree, LATERAL sloc_lines(content)").first()[0] == 60
    assert spark.sql("SELECT rule_id FROM py_findings(encode('v = True if f() else False', 'UTF-8'))").first()[0] == "py.boolean-conditional"
    assert spark.sql("SELECT * FROM clone_runs(encode('def f(:', 'UTF-8'))").count() == 0
