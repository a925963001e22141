"""Operators on small tables with values worked out by hand, and the SQL oracles on the smallest shared tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codestrata.functions import fingerprints, globs, linediff
from codestrata.operators import architecture, checks, clones, continuity, coverage, evidence, graph, history, matching, ratios, reviews, scoring
from codestrata.plans import evidence_queries, table_queries
from codestrata.sources import reports
from codestrata.streaming import snapshots

SF = "/root/testdata/sf0.001"
FILES = "path string, language string, cohort string, sloc int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


# --- globs, hashes, lines ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("**/*.py", ["a.py", "x/y/a.py"], ["a.pyc", "a.py/b"]),
        ("tests/**/*.py", ["tests/a.py", "tests/x/a.py"], ["a/tests/b.py", "tests/a.txt"]),
        ("**/test_*.py", ["test_a.py", "x/test_.py"], ["x/atest_b.py"]),
        ("**/__pycache__/**", ["__pycache__/a", "x/__pycache__/y/z"], ["__pycache__x/a"]),
        ("build/**", ["build/a", "build/x/a", "build"], ["abuild/a"]),
        ("a?[!b].x", ["aac.x"], ["aab.x", "a/c.x"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r.path for r in df.filter(globs.matches_any(F.col("path"), [pattern])).collect()} == set(yes)


def test_cohorts_and_reasons_in_order(spark):
    table = [
        ("a.py", "python", False, False, None, b"x"), ("tests/t.py", "python", False, False, None, b"x"), ("l.py", "python", True, True, None, None), ("build/b.py", "python", False, True, None, b"x"),
        ("i.py", "python", False, True, None, b"x"), ("r.md", None, False, False, None, b"x"), ("s.pyi", "python", False, False, None, b"x"), ("e.py", "python", False, False, "denied", None), ("g.py", "python", False, False, None, b"# Generated by x"),
    ]
    df = spark.createDataFrame([(p, lang, s, g, e, None if c is None else bytearray(c)) for p, lang, s, g, e, c in table], "path string, language string, is_symlink boolean, git_ignored boolean, read_error string, content binary")
    got = coverage.classify(df, production=["**/*.py"], test=["tests/**/*.py"], exclusions=["build/**"], markers=["@generated", "Generated by"])
    assert {r.path: (r.state, r.reason or r.cohort) for r in got.collect()} == {
        "a.py": ("scored", "production"), "tests/t.py": ("scored", "test"), "l.py": ("excluded", "symlink"), "build/b.py": ("excluded", "configured exclusion"), "i.py": ("excluded", "git ignored"),
        "r.md": ("unsupported", "unsupported"), "s.pyi": ("excluded", "outside configured cohorts"), "e.py": ("failed", "read error"), "g.py": ("excluded", "generated"),
    }


def test_fingerprints(spark):
    df = spark.createDataFrame([(["ab", "c"],), (["a", "bc"],), (["ab", "c"],)], "t array<string>").select(fingerprints.token_fingerprint(F.col("t")).alias("f"))
    assert df.distinct().count() == 2
    df = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{ "a" : "é", "b": 1}',), (None,)], "t string").select(fingerprints.json_digest("t").alias("d"))
    assert {r.d for r in df.collect()} == {fingerprints.canonical_digest({"a": "é", "b": 1}), None}


def plain_line_delta(old, old_code, new, new_code):
    """Lines kept by the alignment of the two whole files, then code lines that are not kept as code on both sides."""
    import difflib

    split = lambda b: [] if b is None else b.replace(b"\r\n", b"\n").replace(b"\r", b"\n").splitlines()
    blocks = difflib.SequenceMatcher(None, split(old), split(new), autojunk=False).get_matching_blocks()
    kept = {(a + i + 1, b + i + 1) for a, b, n in blocks for i in range(n)}
    both = {(a, b) for a, b in kept if a in old_code and b in new_code}
    return [n for n in new_code if n not in {b for _, b in both}], [n for n in old_code if n not in {a for a, _ in both}]


@pytest.mark.parametrize("seed", range(4))
def test_line_deltas(spark, seed):
    rng, table = random.Random(seed), []
    for _ in range(25):
        lines = [rng.choice([b"dig()", b"rake()", b"# aside", b"", b"sow(1)"]) for _ in range(rng.randrange(1, 9))]
        other = [x for x in lines if rng.random() < 0.8]
        other.insert(rng.randrange(len(other) + 1), rng.choice([b"water()", b"dig()"]))
        sides = []
        for side in (lines, other):
            code = [n for n, x in enumerate(side, 1) if x and (not x.startswith(b"#") or rng.random() < 0.2)]
            sides += [bytearray(rng.choice([b"\n", b"\r\n"]).join(side)), code]
        table.append(tuple(sides))
    table.append((None, [], bytearray(b"sow(1)\n"), [1]))
    expect = [plain_line_delta(*(bytes(x) if isinstance(x, bytearray) else x for x in row)) for row in table]
    assert [linediff.line_delta(*(bytes(x) if isinstance(x, bytearray) else x for x in row))[:2] for row in table] == expect
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(table)], "i int, before binary, old_lines array<int>, after binary, new_lines array<int>")
    got = {r.i: (r.added, r.deleted) for r in linediff.with_line_deltas(df).collect()}
    assert [got[i] for i in range(len(table))] == expect


# --- ratios -----------------------------------------------------------------------------------------------------------


def test_erosion_by_hand(spark):
    files = spark.createDataFrame([("small", "python", "production", 1), ("large", "python", "production", 100), ("none", "other", "test", 5)], FILES)
    calls = spark.createDataFrame([("small", 11, None, 1), ("large", 1, None, 100)], "path string, complexity int, assertion_count int, sloc int")
    got = {(r.language, r.cohort): r for r in ratios.erosion(files, calls).collect()}
    assert (got["python", "production"].numerator, got["python", "production"].denominator) == (1, 21)
    assert got["python", "test"].reason == "no-source-lines" and got["other", "test"].reason == "no-functions"
    one = spark.createDataFrame([("f", "python", "production", 9)], FILES)
    three = spark.createDataFrame([("f", 10, 0, 4), ("f", 11, 0, 9), ("f", 1, 0, 2)], calls.schema)
    row = ratios.erosion(one, three, per_file=True).first()
    assert (row.numerator, row.denominator) == (3, pytest.approx(53 + math.sqrt(2)))
    for cohort, expect in (("test", (0, 2)), ("production", (12, 32))):
        asserted = spark.createDataFrame([("f", 16, 15, 4)], calls.schema)
        row = ratios.erosion(one.withColumn("cohort", F.lit(cohort)), asserted).filter(F.col("cohort") == cohort).first()
        assert (row.numerator, row.denominator) == expect


def test_ratio_failures_and_repartitioning(spark):
    files = spark.createDataFrame([("a", "p", "production", 4), ("b", "p", "production", 6)], FILES)
    flags = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "path string, line int")
    for n in (1, 3, 8):
        row = ratios.line_ratio(files.repartition(n), flags.repartition(n), "m").filter("cohort = 'production'").first()
        assert (row.numerator, row.denominator, row.value) == (2, 10, 0.2)
    bad = spark.createDataFrame([("b", "analyzer-failed")], "path string, reason string")
    row = ratios.line_ratio(files, flags, "m", failed=bad).filter("cohort = 'production'").first()
    assert (row.state, row.value, row.reason) == ("unavailable", None, "analyzer-failed")
    worse = spark.createDataFrame([("a", "clones-failed")], bad.schema)
    row = ratios.combined_ratio(files, flags, flags, failed_patterns=bad, failed_clones=worse).filter("cohort = 'production'").first()
    assert row.state == "unavailable"


# --- duplicates -------------------------------------------------------------------------------------------------------

CAND = "language string, cohort string, normalization_version string, fingerprint string, path string, start_line int, end_line int, sloc int"


def candidates(spark, *items):
    return spark.createDataFrame([("python", c, v, f, p, a, b, b - a + 1) for f, p, a, b, c, v in ((*i, "production", "v1")[:6] if len(i) == 4 else i for i in items)], CAND)


def groups_of(df):
    got = clones.clone_members(df, clones.clone_groups(df))
    out = {}
    for r in clones.without_contained(got).collect():
        out.setdefault(r.fingerprint, set()).add((r.path, r.start_line, r.end_line))
    return out


def test_groups_need_two_distinct_instances(spark):
    df = candidates(spark, ("f", "a", 1, 8), ("f", "b", 1, 8), ("f", "t", 1, 8, "test", "v1"), ("f", "v", 1, 8, "production", "v2"), ("g", "a", 1, 4), ("g", "a", 3, 6), ("h", "a", 1, 3), ("h", "a", 5, 7))
    assert groups_of(df.repartition(5)) == groups_of(df) and set(groups_of(df)) == {"f", "h"}
    assert {r.fingerprint for r in clones.clone_groups(df).collect()} == {"f", "h"}


def test_containment_needs_an_enclosing_member_each(spark):
    both = [("o", "a", 1, 8), ("o", "b", 1, 8)]
    assert set(groups_of(candidates(spark, *both, ("i", "a", 2, 4), ("i", "b", 2, 4)))) == {"o"}
    assert set(groups_of(candidates(spark, *both, ("i", "a", 2, 4), ("i", "b", 2, 4), ("i", "c", 2, 4)))) == {"o", "i"}
    assert set(groups_of(candidates(spark, *both, ("i", "a", 1, 3), ("i", "a", 5, 7)))) == {"o", "i"}
    assert clones.assignable([[1, 2], [1]]) and not clones.assignable([[1], [1]]) and clones.assignable([[1], [1, 2], [2, 3]])


# --- matching and continuity ------------------------------------------------------------------------------------------

SIDE = "path string, language string, cohort string, content_hash string"


def test_file_matching_stages(spark):
    old = spark.createDataFrame([("same", "p", "x", "1"), ("edit", "p", "x", "2"), ("moved", "p", "x", "3"), ("moved2", "p", "x", "3"), ("gone", "p", "x", "4"), ("bad", "p", "x", None), ("pop", "p", "x", "5"), ("hint", "p", "x", "6")], SIDE)
    new = spark.createDataFrame([("same", "p", "x", "1"), ("edit", "p", "x", "9"), ("to", "p", "x", "3"), ("come", "p", "x", "7"), ("bad", "p", "x", "1"), ("pop", "p", "y", "5"), ("hinted", "p", "x", "8")], SIDE)
    hints = spark.createDataFrame([("hint", "hinted"), ("same", "same"), ("hint", "come")], "baseline_path string, current_path string")
    got = matching.match_files(old, new, hints)
    kinds = {(r.baseline_path, r.current_path): r.kind for r in got.collect()}
    assert kinds == {
        ("same", "same"): "unchanged", ("edit", "edit"): "modified", ("moved", "to"): "renamed", ("moved2", None): "deleted", ("gone", None): "deleted", ("bad", "bad"): "unresolved",
        ("pop", None): "deleted", (None, "pop"): "added", (None, "hinted"): "added", ("hint", "come"): "renamed",
    }
    for side, files in (("baseline_path", old), ("current_path", new)):
        assert checks.unpaired_files(files, got, side).isEmpty()


def test_totals_are_unavailable_for_a_reason(spark):
    d = spark.createDataFrame([("p", 4, 6, 3, 1, None), ("q", 0, 2, 2, 0, None), ("r", 1, 1, 0, 0, "unreadable"), ("r", 1, 1, 0, 0, "parse-failed")], "k string, baseline_sloc int, current_sloc int, added int, deleted int, reason string")
    got = {r.k: r for r in matching.loc_totals(d, ["k"]).collect()}
    assert (got["p"].net, got["p"].growth, got["q"].growth, got["r"].reason, got["r"].net) == (2, 0.5, None, "parse-failed", None)
    assert checks.line_delta_violations(matching.loc_totals(d, ["k"]).filter("state = 'measured'")).isEmpty()


OCC = "occ string, pair string, rule_id string, scope string, statement string, path string, start_line int, end_line int"


def test_pattern_continuity_passes(spark):
    old = spark.createDataFrame([("1", "f", "r", "s", "A", "f", 4, 4), ("2", "f", "r", "t", "B", "f", 8, 8), ("3", "f", "q", "", "C", "f", 9, 9), ("4", "g", "r", "s", "A", "g", 1, 1)], OCC)
    new = spark.createDataFrame([("a", "f", "r", "s", "A", "f", 6, 6), ("b", "f", "r", "t", "Z", "f", 9, 9), ("c", "f", "q", "", "D", "f", 9, 9), ("d", "h", "r", "s", "A", "h", 1, 1)], OCC)
    missing = spark.createDataFrame([("4",)], "occ string")
    got = continuity.pattern_changes(old, new, unusable_old=missing)
    assert rows(got, "state", "old_occ", "new_occ") == [("changed", "2", "b"), ("introduced", None, "d"), ("persisted", "1", "a"), ("unresolved", "3", None), ("unresolved", "4", None), ("unresolved", None, "c")]


def test_aligned_ends_pair_repeated_occurrences(spark):
    old = spark.createDataFrame([("1", "f", "r", "s", "A", "f", 4, 4), ("2", "f", "r", "s", "A", "f", 5, 5)], OCC)
    new = spark.createDataFrame([("a", "f", "r", "s", "A", "f", 6, 6), ("b", "f", "r", "s", "A", "f", 7, 7), ("c", "f", "r", "s", "A", "f", 8, 8)], OCC)
    lines = spark.createDataFrame([("f", "f", 4, 6), ("f", "f", 5, 8)], "old_path string, new_path string, old_line int, new_line int")
    got = continuity.stable_pairs(old, new, ["rule_id", "statement"], lines)
    assert rows(got, "old_occ", "new_occ") == [("1", "a"), ("2", "c")]


def test_relations_and_group_resolution(spark):
    pairs = spark.createDataFrame([("1", "a", True, 4), ("1", "b", False, 4), ("2", "c", True, 4), ("3", "d", True, 4)], "old_occ string, new_occ string, same_owner boolean, statements int")
    anchors = spark.createDataFrame([("1", "a", x) for x in "xyz"] + [("2", "c", "x")] * 3, "old_occ string, new_occ string, fingerprint string")
    assert rows(continuity.anchored_relation(pairs, anchors), "old_occ", "new_occ", "relation") == [("1", "a", "anchored"), ("1", "b", "unrelated"), ("2", "c", "uncertain"), ("3", "d", "unrelated")]
    edges = spark.createDataFrame([("g1", "h1"), ("g2", "h2"), ("g2", "h3")], "old_group string, new_group string")
    assert {(r.old_group or r.new_group): r.resolution for r in continuity.resolve_groups(edges).collect()} == {"g1": "paired", "h1": "paired", "g2": "ambiguous", "h2": "ambiguous", "h3": "ambiguous"}


# --- scores -----------------------------------------------------------------------------------------------------------


def test_percentiles_and_remainders(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0.1, 0.2, 0.3, 0.8, 1)], "v double").withColumn("values", F.array(*map(F.lit, [0.0, 0.2, 0.2, 0.8])))
    assert [float(r.p) for r in df.select(scoring.percentile(F.col("values"), F.col("v")).alias("p")).collect()] == [0, 25, 25, 75, 75, 100]
    parts = spark.createDataFrame([("s", "erosion", 0.3, 0.5), ("s", "verbosity.combined", 0.3, 0.5)], "scope string, metric_id string, raw double, weight double")
    parts = parts.withColumn("percentile", scoring.percentile(F.array(*map(F.lit, [0.0, 0.5, 0.9])), F.col("raw"))).withColumn("transform", F.lit("percentile"))
    got = {r.metric_id: float(r.points) for r in scoring.contributions(parts, ["scope"]).collect()}
    assert got == {"erosion": 16.7, "verbosity.combined": 16.6}
    populations = spark.createDataFrame([("x", None, 100, [1.0]), ("x", 100, None, [2.0])], "k string, min_sloc int, max_sloc int, values array<double>")
    observed = spark.createDataFrame([("x", 99), ("x", 100), ("y", 1)], "k string, sloc int")
    assert rows(scoring.with_population(observed, populations, ["k"]), "sloc", "values") == [(1, None), (100, [2.0]), (99, [1.0])]


# --- graphs, boundaries, history --------------------------------------------------------------------------------------


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "a"), ("s", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "a"), ("p", "q"), ("b", "d"), ("d", "e"), ("e", "d")], "importer string, imported string")
    assert rows(graph.cycles(edges)) == [("a", "a"), ("b", "a"), ("d", "d"), ("e", "d"), ("s", "s"), ("x", "x"), ("y", "x"), ("z", "x")]
    assert graph.cycles(edges.limit(0)).count() == 0
    assert graph.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a int, b int")).count() == 0
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(chain).filter("component <> 0").count() == 0


def test_long_and_many_cycles_settle(spark):
    # A ring of 410 in name order (before: no cycle), and pairs chained in name order, more than the rounds allowed.
    ring = spark.range(410).select(F.col("id").alias("importer"), ((F.col("id") + 1) % 410).alias("imported"))
    assert rows(graph.cycles(ring)) == sorted([(k, 0) for k in range(410)], key=str)
    pairs = [(k, k ^ 1) for k in range(12)] + [(k, k + 2) for k in range(0, 10, 2)]
    got = graph.cycles(spark.createDataFrame(pairs, "importer long, imported long"), max_rounds=3)
    assert rows(got) == sorted([(k, k // 2 * 2) for k in range(12)], key=str)


def test_cycles_by_brute_force(spark):
    rng = random.Random(5)
    n, m = 40, 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    reach = {a: {b for x, b in edges if x == a} for a in range(n)}
    for k in range(n):
        for a in range(n):
            reach[a] |= reach[k] if k in reach[a] else set()
    expect = [(a, min(b for b in reach[a] if a in reach[b])) for a in range(n) if a in reach[a]]
    got = graph.cycles(spark.createDataFrame(sorted(edges), "importer long, imported long"), max_rounds=2)
    assert rows(got) == sorted(expect, key=str)


def test_components_cover_all_of_lineitem(spark, tmp_path):
    # Three components; before, only the row with l_orderkey 1 was read.
    pairs = [(1, 10, 1), (2, 20, 1), (3, 30, 2), (212 * 5, 40, 2), (5, 30, 3), (6, 50, 4)]
    spark.createDataFrame(pairs, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    s = 1_000_000_000
    expect = [(10, 10), (20, 10), (s + 1, 10), (30, 30), (40, 30), (s + 2, 30), (s + 3, 30), (50, 50), (s + 4, 50)]
    assert rows(table_queries.WITHOUT_SQL["components"](spark, str(tmp_path))) == sorted(expect, key=str)

    least = {}  # brute force over the smallest shared table: every edge levels its ends until nothing moves
    edges = {(r.l_partkey, r.l_suppkey + s) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(least.setdefault(a, a), least.setdefault(b, b))
            moved, least[a], least[b] = moved or least[a] != m or least[b] != m, m, m
    assert rows(table_queries.WITHOUT_SQL["components"](spark, SF)) == sorted(least.items(), key=str)


def test_import_cycles_cover_all_of_lineitem(spark):
    edges = {(f"p{r.l_partkey % 60}", f"p{r.l_suppkey % 45}") for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    nodes = {x for e in edges for x in e}
    reach = {a: {b for x, b in edges if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            reach[a] |= reach[k] if k in reach[a] else set()
    expect = [(a, min(b for b in reach[a] if a in reach[b])) for a in nodes if a in reach[a]]
    assert rows(table_queries.WITHOUT_SQL["import_cycles"](spark, SF)) == sorted(expect, key=str)
    assert {tuple(r) for r in table_queries._edges(spark, SF).distinct().collect()} == edges


def test_module_names_and_imports(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/p/__init__.py",), ("lib/a.py",), ("src/1x.py",), ("other/z.py",)], "path string")
    assert rows(architecture.module_index(files, ["src", "lib"]), "path", "module", "status") == [("lib/a.py", "a", "ambiguous"), ("other/z.py", None, "outside"), ("src/1x.py", "1x", "invalid"), ("src/a.py", "a", "ambiguous"), ("src/p/__init__.py", "p", "unique")]
    df = spark.createDataFrame([("a.b.c", False, 1, "x"), ("a.b", True, 1, "x"), ("a", False, 1, None), ("a", False, 2, "x"), ("a", False, 0, "k.l")], "m string, pkg boolean, level int, target string")
    assert [r.t for r in df.select(architecture.absolute_target(F.col("m"), F.col("pkg"), F.col("level"), F.col("target")).alias("t")).collect()] == ["a.b.x", "a.b.x", None, None, "k.l"]


def test_history_fold(spark):
    line = "language string, cohort string, path string, line int"
    pairs = "language string, cohort string, old_path string, old_line int, new_path string, new_line int"
    make = lambda rows_, schema: spark.createDataFrame([("p", "x", *r) for r in rows_], schema)
    day = history.DAY
    steps = [
        {"revision": "1", "ts": 2 * day, "aligned": make([("f", 1, "f", 1)], pairs), "added": make([("f", 2)], line), "deleted": make([("f", 3)], line)},
        {"revision": "2", "ts": 16 * day, "aligned": make([("f", 1, "g", 1)], pairs), "added": make([("g", 2)], line), "deleted": make([("f", 2)], line)},
        {"revision": "3", "ts": 15 * day, "aligned": make([("g", 1, "g", 1)], pairs), "added": make([], line), "deleted": make([("g", 2), ("g", 1)], line)},
    ]
    got = history.fold_history(make([("f", 1), ("f", 3)], line), steps)
    assert rows(got, "revision", "path", "line", "state", "reason", "age_seconds") == [
        ("1", "f", 3, "unresolved", "unknown-introduction", None), ("2", "f", 2, "recent", None, 14 * day), ("3", "g", 1, "unresolved", "unknown-introduction", None), ("3", "g", 2, "unresolved", "timestamp-order", None),
    ]


# --- reviews, reports, queries ----------------------------------------------------------------------------------------


def test_reviews(spark, tmp_path):
    source = "kind string, language string, cohort string, symbol string, paths array<string>, evidence_fingerprint string, source_hashes array<string>, boundary string, analysis_version string, settings string"
    found = spark.createDataFrame([("pattern", "p", "x", "f", ["b", "a"], "e1", ["h"], None, "1", None), ("pattern", "p", "x", "f", ["a", "b"], "e1", ["h"], None, "1", None), ("error", "p", "x", "g", ["a"], "e2", [None], None, "1", None)], source)
    targets = reviews.targets(found).cache()
    assert targets.count() == 2 and rows(targets.filter("kind = 'error'"), "unavailable") == [("missing-source-hash",)]
    target = targets.filter("kind = 'pattern'").first()
    event = {k: target[k] for k in ("review_id", "kind", "language", "cohort", "symbol", "evidence_fingerprint", "source_hashes", "boundary", "analysis_fingerprint")} | {"disposition": "keep", "recorded_at": "2024-01-01T00:00:00Z"}
    path = tmp_path / "ledger.json"
    reports.append_event(path, event)
    ledger = reports.append_event(path, event | {"disposition": "fix", "evidence_fingerprint": "old"})
    events = reports.events_table(spark, ledger)
    assert reviews.ledger_violations(events).isEmpty() and [r.disposition for r in reviews.latest(events).collect()] == ["fix"]
    row = reviews.resolve(events, targets, "snapshot").first()
    assert (row.state, row.causes) == ("stale", ["evidence"])
    assert reviews.resolve(events, targets, "errors").first().state == "not-in-selected-report"
    assert reviews.resolve(events.filter("sequence = 1"), targets, "snapshot").first().state == "current"
    assert reviews.resolve(events, targets.limit(0), "snapshot").first().state == "missing"
    more = reviews.append(events, events.limit(1))
    assert sorted(r.sequence for r in more.collect()) == [1, 2, 3]
    assert rows(reviews.ledger_violations(events.filter("sequence = 2")), "rule") == [("sequence",)]
    assert reports.load_report(_saved(tmp_path, {"experiment": "py-derived-state-1"}))[0] == "derived"


def _saved(folder, data):
    path = folder / "report.json"
    path.write_text(reports.to_json(data))
    return path


def test_profiles(tmp_path):
    reports.save_profile(tmp_path, {"profile_id": "py-2026.3", "x": 1}, b"manifest")
    assert reports.load_profile(tmp_path, "py-2026.3")["x"] == 1
    (tmp_path / "py-2026.3.corpus.toml").write_bytes(b"other")
    with pytest.raises(ValueError, match="match"):
        reports.load_profile(tmp_path, "py-2026.3")


def test_evidence_queries(spark):
    f = spark.createDataFrame([("a", 1, 1, "r", "warning"), ("b", 1, 1, "q", "warning")], "path string, start_line int, end_line int, rule_id string, severity string")
    m = spark.createDataFrame([("g", "a", 1, 2), ("g", "b", 1, 2), ("h", "c", 1, 2)], "group_id string, path string, start_line int, end_line int")
    c = spark.createDataFrame([("a", "f", 1, 9, "production", 11, 0), ("a", "g", 1, 9, "production", 10, 0), ("a", "h", 1, 9, "test", 12, 3)], "path string, qualified_name string, start_line int, end_line int, cohort string, complexity int, assertion_count int")
    got = evidence.query_findings(f, m, c, path="a")
    assert {k: v.count() for k, v in got.items()} == {"patterns": 1, "clones": 2, "functions": 1}
    assert set(evidence.query_findings(f, m, c, rule="q")) == {"patterns"} and set(evidence.query_findings(f, m, c, metric="combined")) == {"patterns", "clones"}
    with pytest.raises(ValueError, match="patterns"):
        evidence.query_findings(f, m, c, metric="erosion", rule="q")
    with pytest.raises(evidence.LookupFailure, match="ambiguous"):
        evidence.only(f, "finding")


def test_dense_ids_and_checks(spark):
    df = spark.createDataFrame([(i % 37,) for i in range(200)], "k int")
    got = {r.k: r.id for r in coverage.dense_ids(df, "d", ["k"]).collect()}
    assert got == {k: f"d-{k + 1:04d}" for k in range(37)}
    assert checks.repeated_keys(df, ["k"]).count() == 37 and checks.orphans(df, df.filter("k < 36"), ["k"]).count() == 5


def test_streams_equal_batches(spark, tmp_path):
    changes = spark.createDataFrame([("p", "x", "f", 1, "me", f"2024-01-0{d} 0{h}:00:00", h, d) for d in (1, 2, 3) for h in (1, 2, 7)], "language string, cohort string, path string, line int, author string, ts string, added int, deleted int").withColumn("ts", F.to_timestamp("ts"))
    changes.write.parquet(str(tmp_path / "in"))
    for name, build in (("churn", snapshots.daily_churn), ("sessions", snapshots.author_sessions)):
        stream = build(snapshots.read_changes(spark, str(tmp_path / "in")))
        running = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
        running.awaitTermination(60)
        assert rows(spark.table(name)) == rows(build(changes))


def test_spans_are_all_rows_of_lineitem(spark):
    spans = {(r.l_suppkey, r.l_linenumber * 10, r.l_linenumber * 10 + int(r.l_quantity)) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_quantity").collect()}
    by_key = {}
    for path, start, end in spans:
        by_key.setdefault(path, []).append((start, end))
    overlaps = [(path, sum(a <= d and b >= c for a, b in own for c, d in own)) for path, own in by_key.items()]
    enclosures = [(path, sum(c <= a and d >= b for a, b in own for c, d in own)) for path, own in by_key.items()]
    assert rows(table_queries.WITHOUT_SQL["span_overlaps"](spark, SF)) == sorted(overlaps, key=str)
    assert rows(table_queries.WITHOUT_SQL["span_enclosures"](spark, SF)) == sorted(enclosures, key=str)


def test_overlapping_bands_equal_pairs(spark):
    """Null ends, copies, bands of no size and null keys; and no group meets itself in a join."""
    draw = random.Random(6)
    ends = [None, *range(-2, 13)]
    bands = [("file", draw.choice([None, *map(str, range(250))]), "full", "m", draw.choice(ends), draw.choice(ends), [1.0]) for _ in range(500)]
    df = spark.createDataFrame(bands + bands[::2], "kind string, cohort string, model string, metric_id string, min_sloc int, max_sloc int, values array<double>")
    got = checks.profile_violations(df).filter("rule = 'bands'")

    def meet(a, b):
        return (0 if a[4] is None else a[4]) < (1e18 if b[5] is None else b[5])

    expect = {(a[1],) for a in bands for b in bands if a[1] is not None and a[1] == b[1] and a[4:6] != b[4:6] and meet(a, b) and meet(b, a)}
    assert rows(got, "cohort") == sorted(expect, key=str) and 50 < len(expect) < 150
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


# --- oracles ----------------------------------------------------------------------------------------------------------

SLOW = {"commit_chain"}


@pytest.mark.parametrize("name", sorted({*table_queries.QUERIES} - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "supplier", "nation", "region", "part", "orders", "lineitem", "events", "documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expect = con.execute(evidence_queries.ORACLES[name]).df()
    got = evidence_queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)

    def plain(df):
        tidy = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted(str([tidy(v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))

    assert plain(got) == plain(expect)


def beside_sql(spark, folder, name, table, df):
    """Rows of a query, and of its SQL, on one table."""
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(evidence_queries.QUERIES[name](spark, str(folder))), sorted(con.execute(evidence_queries.ORACLES[name]).fetchall(), key=str)


def test_unknown_sizes_are_in_no_band(spark, tmp_path):
    parts = [("a", 1, 3), ("a", 1, None), ("b", 1, 3), ("b", None, 3), ("c", 1, 3), ("c", 2, 4), ("d", -3, 3), ("d", 1, 2), ("e", 2, 3), ("e", 2, 3), ("e", 2, 4), (None, 1, 3), (None, 2, 3)]
    got, expect = beside_sql(spark, tmp_path, "overlapping_bands", "part", spark.createDataFrame(parts, "p_brand string, p_partkey long, p_size int"))
    assert got == expect == [("c",), ("d",)]


def test_halves_become_even_complexity(spark, tmp_path):
    orders = [(k * 10 + key, key, "F", k * 5000.0 + cents, "1-URGENT") for k in range(-4, 8) for key, cents in ((1, 0.0), (2, 0.01), (3, 0.0), (7, -0.01))]
    got, expect = beside_sql(spark, tmp_path, "complexity_by_version", "orders", spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"))
    assert got == expect
    assert [dict(got)[k * 10 + 1] for k in (-3, -1, 1, 3, 5, 7)] == [-2, 0, 0, 2, 2, 4]
