"""Operators on the shared test tables, each beside the same computation in plain SQL.

The tables hold no source code, so their columns take the roles of evidence: a document is a file with its language, its
source gives the cohort, orders are callables, events are line changes, and so on.  Each entry of ``QUERIES`` takes a
session and a folder; the entry of ``ORACLES`` with the same name is SQL over views of the tables' names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..operators import architecture, budgets, clones, continuity, coverage, graph, history, matching, ranking, ratios, scoring
from ..operators.lines import enclosing_spans, overlapping_spans, span_lines, union_lines
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries over whole tables that have no SQL here; the tests compare them to brute force.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def query_without_sql(f: Callable[[SparkSession, str], DataFrame]):
    WITHOUT_SQL[f.__name__] = f
    return f


# --- roles ----------------------------------------------------------------------------------------------------------


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines of documents: path, language, cohort, line, text."""
    cohort = F.when(matches_any(F.col("source"), ["src1*"]), "test").otherwise("production")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), cohort.alias("cohort"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return docs.select("path", "language", "cohort", (F.col("at") + 1).alias("line"), "text").filter("trim(text) <> ''")


LINES = """lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, lang AS language, CASE WHEN source LIKE 'src1%' THEN 'test' ELSE 'production' END AS cohort, line, text
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM documents)
  WHERE trim(text, ' ') <> '')"""


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).groupBy("path", "language", "cohort").agg(F.count(F.lit(1)).alias("sloc"))


def flagged_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.length("text") > 200).select("path", "line")


def cloned_lines(lines: DataFrame) -> DataFrame:
    copies = lines.groupBy("text").agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a <> b").select("text")
    return lines.join(copies, "text").select("path", "line")


# --- line sets and ratios -------------------------------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT language, CAST(count(*) AS BIGINT) AS sloc, CAST(count(DISTINCT path) AS BIGINT) AS files FROM lines GROUP BY language""")
def sloc_by_language(spark, sf):
    """Files and source lines."""
    return doc_lines(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("sloc"), F.countDistinct("path").alias("files"))


_FLAG = "flag AS (SELECT DISTINCT path, line FROM lines WHERE length(text) > 200)"
_CLONE = "clone AS (SELECT DISTINCT path, line FROM lines WHERE text IN (SELECT text FROM lines GROUP BY text HAVING count(DISTINCT path) > 1))"


@query(
    f"""WITH {LINES}, {_FLAG}, {_CLONE}, comb AS (SELECT * FROM flag UNION SELECT * FROM clone),
    den AS (SELECT language, cohort, count(*) AS d FROM lines GROUP BY 1, 2),
    num AS (SELECT m, language, cohort, count(*) AS n FROM (SELECT 'verbosity.patterns' AS m, * FROM flag UNION ALL SELECT 'verbosity.clones', * FROM clone UNION ALL SELECT 'verbosity.combined', * FROM comb)
            JOIN lines USING (path, line) GROUP BY 1, 2, 3)
    SELECT g.metric_id, g.language, g.cohort, CASE WHEN d IS NULL THEN 'unavailable' ELSE 'measured' END AS state,
      CASE WHEN d IS NOT NULL THEN CAST(coalesce(n, 0) AS DOUBLE) END AS numerator, CAST(d AS DOUBLE) AS denominator, round(coalesce(n, 0) / d, 8) AS value, CASE WHEN d IS NULL THEN 'no-source-lines' END AS reason
    FROM (SELECT DISTINCT m AS metric_id, language, c AS cohort FROM (SELECT unnest(['verbosity.patterns', 'verbosity.clones', 'verbosity.combined']) AS m), (SELECT DISTINCT language FROM lines), (SELECT unnest(['production', 'test']) AS c)) g
    LEFT JOIN den ON den.language = g.language AND den.cohort = g.cohort
    LEFT JOIN num ON num.m = g.metric_id AND num.language = g.language AND num.cohort = g.cohort"""
)
def verbosity_by_cohort(spark, sf):
    """Three ratios for every language and cohort."""
    lines, files = doc_lines(spark, sf), doc_files(spark, sf)
    flag, clone = flagged_lines(lines), cloned_lines(lines)
    rows = ratios.line_ratio(files, flag, "verbosity.patterns").unionByName(ratios.line_ratio(files, clone, "verbosity.clones")).unionByName(ratios.combined_ratio(files, flag, clone))
    return rows.select("metric_id", "language", "cohort", "state", "numerator", "denominator", F.round("value", 8).alias("value"), "reason")


@query(
    f"""WITH {LINES}, {_FLAG} SELECT path, language, cohort, CAST(count(flag.line) AS DOUBLE) AS numerator, CAST(count(*) AS DOUBLE) AS denominator, round(count(flag.line) / count(*), 8) AS value
    FROM lines LEFT JOIN flag USING (path, line) GROUP BY path, language, cohort"""
)
def verbosity_by_file(spark, sf):
    """E1 at the scope of files."""
    lines = doc_lines(spark, sf)
    rows = ratios.line_ratio(doc_files(spark, sf), flagged_lines(lines), "verbosity.patterns", per_file=True)
    return rows.select("path", "language", "cohort", "numerator", "denominator", F.round("value", 8).alias("value"))


@query(f"""WITH {LINES} SELECT language, cohort, path, CASE WHEN path IS NULL THEN 'project' ELSE 'file' END AS scope, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) AS BIGINT) AS sloc FROM lines GROUP BY GROUPING SETS ((language, cohort, path), (language, cohort))""")
def both_scopes(spark, sf):
    """Files and populations in one pass."""
    rows = doc_lines(spark, sf).select("language", "cohort", "path", F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("sloc"))
    return ratios.both_scopes(rows, ["chars", "sloc"])


_CALLABLES = """calls AS (SELECT o_orderkey AS path, o_orderpriority AS p, CAST(count(*) AS INT) + 8 AS cc, sum(l_quantity) AS sloc, CAST(count(*) FILTER (l_linenumber > 2) AS INT) AS asserts
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


@query(
    f"""WITH {_CALLABLES}, c AS (SELECT *, CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'test' ELSE 'production' END AS cohort FROM calls),
    e AS (SELECT p AS language, cohort, sum(greatest(0, CASE WHEN cohort = 'test' THEN cc - asserts ELSE cc END - 10) * sqrt(sloc)) AS n, sum(CASE WHEN cohort = 'test' THEN cc - asserts ELSE cc END * sqrt(sloc)) AS d FROM c GROUP BY 1, 2)
    SELECT g.language, g.cohort, CASE WHEN d IS NULL THEN 'unavailable' ELSE 'measured' END AS state, round(n / d, 8) AS value, CASE WHEN d IS NULL THEN 'no-source-lines' END AS reason
    FROM (SELECT DISTINCT language, k AS cohort FROM e, (SELECT unnest(['production', 'test']) AS k)) g LEFT JOIN e USING (language, cohort)"""
)
def erosion_by_priority(spark, sf):
    """Orders as callables; their lines are the complexity and late lines the assertions."""
    cohort = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "test").otherwise("production")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sloc"), F.count(F.when(F.col("l_linenumber") > 2, 1)).alias("assertion_count"))
    calls = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    calls = calls.select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("language"), cohort.alias("cohort"), (F.col("n") + 8).alias("complexity"), "sloc", "assertion_count")
    rows = ratios.erosion(calls.select("path", "language", "cohort", "sloc"), calls.select("path", "complexity", "assertion_count", "sloc"))
    return rows.select("language", "cohort", "state", F.round("value", 8).alias("value"), "reason")


@query(
    """SELECT a.conv_id AS conv_id, a.turn AS turn, CAST(count(b.turn) AS BIGINT) AS lines FROM conversations a
    JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2"""
)
def span_line_counts(spark, sf):
    """Spans of three turns and the turns inside them."""
    turns = table(spark, sf, "conversations")
    spans = turns.select("conv_id", "turn", (F.col("turn") - 1).alias("start_line"), (F.col("turn") + 1).alias("end_line"))
    found = span_lines(spans, turns.select("conv_id", F.col("turn").alias("line")), ["conv_id"])
    return found.groupBy("conv_id", "turn").agg(F.count("line").alias("lines"))


def _supplier_spans(spark, sf):
    s = table(spark, sf, "lineitem")
    return s.select(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end_line")).distinct()


@query_without_sql
def span_overlaps(spark, sf):
    """Overlapping spans of a key."""
    s = _supplier_spans(spark, sf)
    return overlapping_spans(s, s, ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("pairs"))


@query_without_sql
def span_enclosures(spark, sf):
    """Spans that enclose another."""
    s = _supplier_spans(spark, sf)
    return enclosing_spans(s, s, ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {LINES}, {_FLAG}, {_CLONE} SELECT path, CAST(count(*) AS BIGINT) AS lines FROM (SELECT * FROM flag UNION SELECT * FROM clone) GROUP BY path""")
def line_union(spark, sf):
    """H1: union of line sets."""
    lines = doc_lines(spark, sf)
    return union_lines(flagged_lines(lines), cloned_lines(lines)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


# --- duplicate blocks -----------------------------------------------------------------------------------------------

_BLOCKS = f"""{LINES}, blocks AS (SELECT a.language, a.cohort, 'v1' AS normalization_version, sha256(a.text || chr(10) || b.text) AS fingerprint, a.path, a.line AS start_line, b.line AS end_line
    FROM lines a JOIN lines b ON a.path = b.path AND b.line = a.line + 1),
  kept AS (SELECT language, cohort, fingerprint, count(*) AS members FROM blocks GROUP BY 1, 2, 3 HAVING count(DISTINCT path) > 1 OR (count(*) > 1 AND min(end_line) < max(start_line)))"""


def _blocks(spark, sf):
    lines = doc_lines(spark, sf)
    b = lines.select("path", (F.col("line") - 1).alias("line"), F.col("text").alias("next"))
    both = lines.join(b, ["path", "line"])
    mark = F.sha2(F.concat_ws("\n", "text", "next").cast("binary"), 256)
    return both.select("language", "cohort", F.lit("v1").alias("normalization_version"), mark.alias("fingerprint"), "path", F.col("line").alias("start_line"), (F.col("line") + 1).alias("end_line"))


@query(f"""WITH {_BLOCKS} SELECT language, cohort, fingerprint, CAST(members AS BIGINT) AS members FROM kept""")
def clone_groups(spark, sf):
    """Groups of equal pairs of lines."""
    return clones.clone_groups(_blocks(spark, sf)).select("language", "cohort", "fingerprint", "members")


@query(f"""WITH {_BLOCKS}, m AS (SELECT fingerprint, language, cohort, path, start_line AS line FROM blocks JOIN kept USING (language, cohort, fingerprint) UNION SELECT fingerprint, language, cohort, path, end_line FROM blocks JOIN kept USING (language, cohort, fingerprint))
    SELECT language, cohort, fingerprint, CAST(count(DISTINCT (path, line)) AS BIGINT) AS lines FROM m GROUP BY 1, 2, 3""")
def clone_line_weights(spark, sf):
    """Distinct lines by group."""
    blocks = _blocks(spark, sf)
    groups = clones.clone_groups(blocks)
    weight = clones.clone_line_weight(clones.clone_members(blocks, groups), doc_lines(spark, sf).select("path", "line"))
    return weight.join(groups, "group_id").select("language", "cohort", "fingerprint", "lines")


# --- two snapshots --------------------------------------------------------------------------------------------------


def _sides(spark, sf):
    """Documents with even ids are the old snapshot, the others the new one; a file's path is half of its id."""
    docs = table(spark, sf, "documents").select(
        (F.col("doc_id") % 2).alias("side"), F.concat(F.lit("d/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("path"), F.col("lang").alias("language"), F.lit("production").alias("cohort"),
        F.when(F.length("text") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"), F.col("n_chars").alias("sloc"),
    )
    return docs.filter("side = 0").drop("side"), docs.filter("side = 1").drop("side")


_SIDES = """docs AS (SELECT doc_id % 2 AS side, 'd/' || CAST(doc_id // 2 AS VARCHAR) AS path, lang AS language, CASE WHEN length(text) > 0 THEN sha256(text) END AS h, n_chars FROM documents),
  a AS (SELECT * FROM docs WHERE side = 0), b AS (SELECT * FROM docs WHERE side = 1),
  s1 AS (SELECT a.language, a.path AS bp, b.path AS cp, CASE WHEN a.h IS NULL OR b.h IS NULL THEN 'unresolved' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS kind FROM a JOIN b ON a.path = b.path AND a.language = b.language),
  a2 AS (SELECT *, row_number() OVER (PARTITION BY language, h ORDER BY path) AS k FROM a WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s1 WHERE bp = a.path AND s1.language = a.language)),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY language, h ORDER BY path) AS k FROM b WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s1 WHERE cp = b.path AND s1.language = b.language)),
  pairs AS (SELECT language, bp AS baseline_path, cp AS current_path, kind FROM s1 UNION ALL
    SELECT coalesce(a2.language, b2.language), a2.path, b2.path, CASE WHEN b2.path IS NULL THEN 'deleted' WHEN a2.path IS NULL THEN 'added' ELSE 'renamed' END FROM a2 FULL OUTER JOIN b2 ON a2.language = b2.language AND a2.h = b2.h AND a2.k = b2.k)"""


@query(f"""WITH {_SIDES} SELECT language, baseline_path, current_path, kind FROM pairs""")
def file_match(spark, sf):
    """Pairs of files."""
    return matching.match_files(*_sides(spark, sf)).select("language", "baseline_path", "current_path", "kind")


@query(
    f"""WITH {_SIDES}, d AS (SELECT p.language, p.kind, coalesce(a.n_chars, 0) AS o, coalesce(b.n_chars, 0) AS n FROM pairs p LEFT JOIN a ON a.path = p.baseline_path AND a.language = p.language LEFT JOIN b ON b.path = p.current_path AND b.language = p.language)
    SELECT language, CAST(sum(o) AS BIGINT) AS baseline_sloc, CAST(sum(n) AS BIGINT) AS current_sloc, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS deleted,
      CAST(sum(n - o) AS BIGINT) AS net, round(sum(n - o) / sum(o), 8) AS growth FROM d GROUP BY language"""
)
def loc_totals(spark, sf):
    """Sums of line deltas by language."""
    old, new = _sides(spark, sf)
    pairs = matching.match_files(old, new)
    rows = pairs.join(old.select(F.col("path").alias("baseline_path"), "language", F.col("sloc").alias("o")), ["baseline_path", "language"], "left").join(new.select(F.col("path").alias("current_path"), "language", F.col("sloc").alias("n")), ["current_path", "language"], "left")
    rows = rows.na.fill(0, ["o", "n"]).select("language", F.col("o").alias("baseline_sloc"), F.col("n").alias("current_sloc"), F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("added"), F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("deleted"), F.lit(None).cast("string").alias("reason"))
    return matching.loc_totals(rows, ["language"]).select("language", "baseline_sloc", "current_sloc", "added", "deleted", "net", F.round("growth", 8).alias("growth"))


@query(
    """WITH m AS (SELECT doc_id % 2 AS side, source AS path, lang AS metric_id, CASE WHEN count(*) < 3 THEN 'unavailable' ELSE 'measured' END AS state, CAST(avg(n_chars) AS DOUBLE) AS value FROM documents GROUP BY 1, 2, 3),
    a AS (SELECT * FROM m WHERE side = 0), b AS (SELECT * FROM m WHERE side = 1),
    j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.metric_id, b.metric_id) AS metric_id, a.value AS o, b.value AS n,
      CASE WHEN a.state IS NULL THEN 'missing-baseline' WHEN b.state IS NULL THEN 'missing-current' WHEN a.state <> 'measured' THEN 'baseline-unavailable' WHEN b.state <> 'measured' THEN 'current-unavailable' END AS reason
      FROM a FULL OUTER JOIN b ON a.path = b.path AND a.metric_id = b.metric_id)
    SELECT path, metric_id, CASE WHEN reason IS NULL THEN 'measured' ELSE 'unavailable' END AS state, CASE WHEN reason IS NULL THEN round(n - o, 6) END AS value, reason FROM j"""
)
def metric_deltas(spark, sf):
    """Metrics of two snapshots."""
    m = table(spark, sf, "documents").groupBy((F.col("doc_id") % 2).alias("side"), F.col("source").alias("path"), F.col("lang").alias("metric_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("value"))
    m = m.withColumn("state", F.when(F.col("n") < 3, "unavailable").otherwise("measured")).withColumn("unit", F.lit("chars"))
    out = matching.metric_deltas(m.filter("side = 0"), m.filter("side = 1"), ["path"])
    return out.select("path", "metric_id", "state", F.round("value", 6).alias("value"), "reason")


@query(
    """WITH d AS (SELECT sha256(text) AS h, CAST(doc_id AS BIGINT) AS id FROM documents), r AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM d WHERE id % 2 = 0), u AS (SELECT h, id, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM d WHERE id % 2 = 1)
    SELECT h, id FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.h = r.h AND u.k = r.k)"""
)
def multiset_removal(spark, sf):
    """H3: even documents less one for each odd one with the same text."""
    d = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
    return matching.take_away(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), ["h"]).select("h", "id")


@query(
    """SELECT CASE WHEN o.a IS NULL THEN 'right' ELSE 'left' END AS side, coalesce(o.a, n.a) AS custkey FROM (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'O') o
    FULL OUTER JOIN (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_orderstatus = 'F') n ON o.a = n.a WHERE o.a IS NULL OR n.a IS NULL"""
)
def set_difference(spark, sf):
    """H2, H7: customers with only open or only finished orders."""
    o = table(spark, sf, "orders")
    sides = [o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey")) for s in "OF"]
    return matching.symmetric_difference(*sides, ["custkey"]).select("side", "custkey")


_CONT = """e AS (SELECT event_id AS occ, user_id AS pair, event_type AS rule_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || CAST(event_id % 3 AS VARCHAR) END AS scope, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS statement, event_id % 2 AS side FROM events),
  o AS (SELECT * FROM e WHERE side = 0), n AS (SELECT * FROM e WHERE side = 1),
  p1 AS (SELECT any_value(o.occ) AS oo, any_value(n.occ) AS nn FROM o JOIN n USING (pair, rule_id, scope, statement) GROUP BY pair, rule_id, scope, statement HAVING count(*) = 1),
  o2 AS (SELECT * FROM o WHERE occ NOT IN (SELECT oo FROM p1)), n2 AS (SELECT * FROM n WHERE occ NOT IN (SELECT nn FROM p1)),
  p2 AS (SELECT any_value(o2.occ) AS oo, any_value(n2.occ) AS nn FROM o2 JOIN n2 USING (pair, rule_id, scope) WHERE scope <> '' GROUP BY pair, rule_id, scope HAVING count(*) = 1),
  o3 AS (SELECT * FROM o2 WHERE occ NOT IN (SELECT oo FROM p2)), n3 AS (SELECT * FROM n2 WHERE occ NOT IN (SELECT nn FROM p2))"""


@query(
    f"""WITH {_CONT} SELECT 'persisted' AS state, oo AS old_occ, nn AS new_occ FROM p1 UNION ALL SELECT 'changed', oo, nn FROM p2
    UNION ALL SELECT CASE WHEN (pair, rule_id) IN (SELECT (pair, rule_id) FROM n3) THEN 'unresolved' ELSE 'removed' END, occ, NULL FROM o3
    UNION ALL SELECT CASE WHEN (pair, rule_id) IN (SELECT (pair, rule_id) FROM o3) THEN 'unresolved' ELSE 'introduced' END, NULL, occ FROM n3"""
)
def pattern_continuity(spark, sf):
    """Events of even and odd ids as findings of two snapshots."""
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("occ"), F.col("user_id").alias("pair"), F.col("event_type").alias("rule_id"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))).alias("scope"),
        F.floor(F.col("value") / 20).cast("string").alias("statement"), (F.col("event_id") % 2).alias("side"),
    )
    return continuity.pattern_changes(e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side")).select("state", "old_occ", "new_occ")


@query(
    """WITH c AS (SELECT event_type AS metric, CASE WHEN event_type = 'click' THEN 'changed' ELSE 'persisted' END AS state FROM events WHERE event_type <> 'view')
    SELECT g.metric, g.state, CAST(count(c.state) AS BIGINT) AS n FROM (SELECT DISTINCT metric, s AS state FROM c, (SELECT unnest(['introduced', 'removed', 'persisted', 'changed', 'unresolved']) AS s)) g LEFT JOIN c ON c.metric = g.metric AND c.state = g.state GROUP BY 1, 2"""
)
def state_counts(spark, sf):
    """Rows by state, zeros included."""
    e = table(spark, sf, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("metric"), F.when(F.col("event_type") == "click", "changed").otherwise("persisted").alias("state"))
    return coverage.state_counts(e, ["introduced", "removed", "persisted", "changed", "unresolved"], ["metric"])


@query(
    """SELECT lang AS language, CAST(count(*) FILTER (n_chars % 3 = 0) AS BIGINT) AS added, CAST(count(*) FILTER (n_chars % 3 = 1) AS BIGINT) AS modified, CAST(count(*) FILTER (n_chars % 3 = 2 AND lang = 'fr') AS BIGINT) AS unresolved,
      CASE WHEN count(*) FILTER (n_chars % 3 = 2 AND lang = 'fr') = 0 AND count(*) FILTER (n_chars % 3 < 2) > 0 THEN round(count(*) FILTER (n_chars % 3 = 0) / count(*) FILTER (n_chars % 3 < 2), 8) END AS novel_ratio FROM documents GROUP BY lang"""
)
def novel_ratio(spark, sf):
    """Share of what is new among what is new or changed."""
    kind = F.col("n_chars") % 3
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.when(kind == 0, "added").when(kind == 1, "modified").when(F.col("lang") == "fr", "unresolved").otherwise("unchanged").alias("state"))
    return continuity.novel_ratio(d, ["language"]).select("language", "added", "modified", "unresolved", F.round("novel_ratio", 8).alias("novel_ratio"))


@query(
    """WITH g AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS before, count(*) FILTER (o_orderstatus = 'O') AS after, count(*) FILTER (o_orderpriority = '1-URGENT') AS modified, count(*) FILTER (o_orderpriority = '2-HIGH') AS added, count(*) FILTER (o_orderpriority = '5-LOW') AS removed, count(*) FILTER (o_orderkey % 50 = 0) AS unresolved FROM orders GROUP BY 1)
    SELECT id, CASE WHEN unresolved > 0 THEN 'unresolved' WHEN before < 2 THEN 'introduced' WHEN after < 2 THEN 'removed' WHEN after > before THEN 'expanded' WHEN after < before THEN 'contracted' WHEN modified + added + removed > 0 THEN 'changed' ELSE 'persisted' END AS state FROM g"""
)
def clone_group_states(spark, sf):
    """States of groups by their counts."""
    n = lambda c: F.count(F.when(c, 1))
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        n(F.col("o_orderstatus") == "F").alias("before"), n(F.col("o_orderstatus") == "O").alias("after"), n(F.col("o_orderpriority") == "1-URGENT").alias("modified"), n(F.col("o_orderpriority") == "2-HIGH").alias("added"),
        n(F.col("o_orderpriority") == "5-LOW").alias("removed"), n(F.col("o_orderkey") % 50 == 0).alias("unresolved"),
    )
    return g.select("id", clones.group_state().alias("state"))


@query(
    """WITH l AS (SELECT * FROM (VALUES ('error', 1900), ('click', 5000), ('view', 10), ('refund', 0)) t(metric, maximum)), o AS (SELECT event_type AS metric, count(*) AS n FROM events GROUP BY 1), b AS (SELECT DISTINCT event_type AS metric FROM events WHERE event_type = 'view' AND event_id % 100 = 0)
    SELECT metric, CAST(maximum AS INTEGER) AS maximum, CAST(coalesce(n, 0) AS BIGINT) AS observed, coalesce(n, 0) > maximum AS exceeded, CASE WHEN metric IN (SELECT metric FROM b) THEN 'incomplete' WHEN coalesce(n, 0) > maximum THEN 'exceeded' ELSE 'pass' END AS state FROM l LEFT JOIN o USING (metric)"""
)
def budget_checks(spark, sf):
    """Events against limits."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "event_id")
    limits = spark.createDataFrame([("error", 1900), ("click", 5000), ("view", 10), ("refund", 0)], "metric string, maximum int")
    return budgets.budget_checks(limits, e, e.filter("metric = 'view' AND event_id % 100 = 0"))


@query(
    """SELECT DISTINCT metric, detail FROM (SELECT event_type AS metric, '{"kind":"late","user":' || CAST(user_id AS VARCHAR) || '}' AS detail FROM events WHERE value > 90 UNION ALL SELECT event_type, '{"kind":"late","user":' || CAST(user_id AS VARCHAR) || '}' FROM events WHERE event_id % 7 = 0)"""
)
def budget_blockers(spark, sf):
    """Blockers of several sources, equal ones once."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.lit("late").alias("kind"), F.col("user_id").alias("user"), "value", "event_id")
    return budgets.merge_blockers(*[e.filter(c).select("metric", "kind", "user") for c in ("value > 90", "event_id % 7 = 0")])


# --- scores ---------------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT c_nationkey, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0)
    SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 0 ELSE round(100.0::DOUBLE * count(r.v) FILTER (r.v < c_acctbal) / count(r.v), 6) END AS percentile FROM customer c JOIN r ON r.c_nationkey = c.c_nationkey GROUP BY c_custkey, c_acctbal"""
)
def percentile_strictly_below(spark, sf):
    """Balances against those of even customers of the nation."""
    c = table(spark, sf, "customer")
    reference = c.filter("c_custkey % 2 = 0").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_acctbal")).alias("values"))
    return c.join(reference, "c_nationkey").select("c_custkey", F.round(scoring.percentile(F.col("values"), F.col("c_acctbal")).cast("double"), 6).alias("percentile"))


@query(
    """WITH s AS (SELECT o_orderpriority AS p, o_orderstatus AS m, 1000.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS a FROM orders GROUP BY 1, 2), f AS (SELECT *, floor(a) AS fl, row_number() OVER (PARTITION BY p ORDER BY a - floor(a) DESC, m) AS k, 1000 - sum(floor(a)) OVER (PARTITION BY p) AS rest FROM s)
    SELECT p AS scope, m AS metric_id, CAST(fl + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM f"""
)
def largest_remainder(spark, sf):
    """a thousand units over the statuses of each priority."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("metric_id")).agg(F.count(F.lit(1)).alias("n"))
    all_ = o.groupBy("scope").agg(F.sum("n").alias("all"))
    rows = o.join(all_, "scope").withColumn("amount", F.lit(1000.0) * F.col("n") / F.col("all")).withColumn("target", F.lit(1000))
    return scoring.largest_remainder(rows, ["scope"], total="target").select("scope", "metric_id", "units")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 4000 THEN 'moderate' WHEN c_acctbal >= 0 THEN 'low' END AS band FROM customer""")
def score_bands(spark, sf):
    """highest lower bound that is reached."""
    return table(spark, sf, "customer").select("c_custkey", scoring.band_of(F.col("c_acctbal"), [("low", 0), ("moderate", 4000), ("high", 7000)]).alias("band"))


@query("""SELECT CASE WHEN p_size * 20 <= 20 THEN '1-20' WHEN p_size * 20 <= 100 THEN '21-100' WHEN p_size * 20 <= 500 THEN '101-500' ELSE '501+' END AS band, CAST(count(*) AS BIGINT) AS files FROM part GROUP BY 1""")
def sloc_bands(spark, sf):
    """Bands of sizes."""
    return table(spark, sf, "part").groupBy(scoring.sloc_band(F.col("p_size") * 20).alias("band")).agg(F.count(F.lit(1)).alias("files"))


@query(
    """WITH o AS (SELECT l_suppkey % 40 AS cohort, 'quantity' AS metric_id, l_orderkey * 10 + l_linenumber AS scope_id, l_quantity AS value FROM lineitem WHERE l_linestatus = 'F'
      UNION ALL SELECT l_suppkey % 40, 'tax', l_orderkey * 10 + l_linenumber, CASE WHEN l_orderkey % 1500 <> 1 THEN l_tax END FROM lineitem WHERE l_linestatus = 'F'),
    s AS (SELECT cohort, count(DISTINCT scope_id) AS n FROM o GROUP BY 1), v AS (SELECT cohort, metric_id, count(value) AS k, sum(value) AS total FROM o GROUP BY 1, 2)
    SELECT CAST(cohort AS BIGINT) AS cohort, metric_id, CAST(k AS BIGINT) AS n, round(total, 4) AS total FROM v JOIN s USING (cohort) WHERE n >= 5 AND k = n"""
)
def calibration_populations(spark, sf):
    """Populations with enough observations in which a metric is never missing."""
    i = table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
    scope = [(F.col("l_suppkey") % 40).alias("cohort"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scope_id")]
    o = i.select(*scope, F.lit("quantity").alias("metric_id"), F.col("l_quantity").alias("value")).unionByName(i.select(*scope, F.lit("tax").alias("metric_id"), F.when(F.col("l_orderkey") % 1500 != 1, F.col("l_tax")).alias("value")))
    rows = scoring.build_populations(o.withColumns({"kind": F.lit("file"), "model": F.lit("full"), "band": F.lit("all")}))
    return rows.select("cohort", "metric_id", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'no-source-lines' WHEN o_orderkey % 11 = 0 THEN 'profile-invalid' WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN 'parse-failed' ELSE 'calibration-missing' END WHEN o_custkey % 5 = 0 THEN 'calibration-incompatible' WHEN o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED' THEN 'required-metric-unavailable' WHEN o_custkey % 7 = 0 THEN 'population-missing' END AS reason FROM orders"""
)
def score_reasons(spark, sf):
    """why a score is missing, in order."""
    o = table(spark, sf, "orders")
    state = scoring.score_state(
        F.when(F.col("o_totalprice") < 1000, 0).otherwise(1), F.when(F.col("o_orderkey") % 11 == 0, "profile-invalid"), F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 5 != 0,
        F.when(F.col("o_orderstatus") == "P", "parse-failed"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "full"), F.col("o_custkey") % 7 != 0,
    )
    return o.select("o_orderkey", state.alias("reason"))


@query(
    """WITH m AS (SELECT c_custkey, bool_or(o_orderstatus = 'F') AS v, bool_or(o_orderstatus = 'O') AS e, bool_or(o_orderstatus = 'P') AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_custkey, CASE WHEN v AND n THEN 'verbosity-only' WHEN v AND e THEN 'full' END AS model FROM m"""
)
def score_models(spark, sf):
    """eligibility of scopes for a model."""
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    rows = o.select(F.col("o_custkey").alias("c_custkey"), F.when(status == "F", "verbosity.combined").otherwise("erosion").alias("metric_id"), F.when(status == "P", "unavailable").otherwise("measured").alias("state"), F.when(status == "P", "no-functions").alias("reason"))
    return scoring.model_of(rows)


# --- order and limits -----------------------------------------------------------------------------------------------


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, c_acctbal AS points FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 5""")
def hotspots(spark, sf):
    """G1."""
    return ranking.hotspots(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_acctbal").alias("points")))


@query(
    """SELECT o_orderkey AS path, CAST(n AS BIGINT) AS complexity, round(n * sqrt(s), 6) AS mass FROM (SELECT o_orderkey, count(*) AS n, sum(l_quantity) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) ORDER BY n * sqrt(s) DESC, o_orderkey LIMIT 5"""
)
def eroded_callables(spark, sf):
    """G3."""
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count(F.lit(1)).alias("complexity"), F.sum("l_quantity").alias("sloc"))
    rows = i.withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "qualified_name": F.lit("f")})
    return ranking.eroded_callables(rows).select("path", "complexity", F.round("mass", 6).alias("mass"))


@query(
    """SELECT path, CAST(rank AS INTEGER) AS rank, delta FROM (SELECT o_orderkey AS path, CASE WHEN a > 0 THEN 1 WHEN b > 0 THEN 2 WHEN c > 0 THEN 3 END AS rank, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END AS delta
      FROM (SELECT o_orderkey, o_orderkey % 7 - 5 AS a, o_orderkey % 11 - 9 AS b, o_custkey % 5 - 1 AS c FROM orders)) WHERE rank IS NOT NULL ORDER BY rank, delta DESC, path LIMIT 5"""
)
def change_priority(spark, sf):
    """G5."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 7 - 5).alias("score_delta"), (F.col("o_orderkey") % 11 - 9).alias("combined_delta"), (F.col("o_custkey") % 5 - 1).alias("erosion_delta"))
    return ranking.change_priority(o).select("path", "rank", "delta")


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, CAST(user_id % 10 AS BIGINT) AS flagged_lines FROM events
    ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, user_id % 10 DESC, CAST(user_id AS VARCHAR), event_id LIMIT 5"""
)
def top_findings(spark, sf):
    """G4."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"), (F.col("user_id") % 10).alias("flagged_lines"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("start_line"), F.lit(1).alias("end_line"), F.lit("r").alias("rule_id"))
    return ranking.top_findings(e).select("event_id", "severity", "flagged_lines")


@query("""SELECT p_brand AS path, printf('part-%04d', row_number() OVER (ORDER BY p_brand, p_type)) AS id, p_type AS type FROM (SELECT DISTINCT p_brand, p_type FROM part)""")
def dense_ids(spark, sf):
    """Numbers by sorted position of distinct rows."""
    return coverage.dense_ids(table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("type")), "part", ["path", "type"])


# --- graphs, boundaries, history ------------------------------------------------------------------------------------

def _edges(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string")).alias("importer"), F.concat(F.lit("p"), (F.col("l_suppkey") % 45).cast("string")).alias("imported"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), n AS (SELECT p_partkey AS m FROM part UNION SELECT a FROM e UNION SELECT b FROM e) SELECT n.m AS module, CAST(count(e.b) AS BIGINT) AS fan_out FROM n LEFT JOIN e ON e.a = n.m GROUP BY 1""")
def fan_out(spark, sf):
    """Suppliers of parts."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("importer"), (F.col("l_suppkey") + 1_000_000_000).alias("imported"))
    return graph.fan_out(table(spark, sf, "part").select(F.col("p_partkey").alias("module")), e)


@query_without_sql
def import_cycles(spark, sf):
    """Strongly connected components with a cycle, over all of lineitem."""
    return graph.cycles(_edges(spark, sf))


@query_without_sql
def components(spark, sf):
    """Connected components of parts and suppliers, over all of lineitem."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    return graph.connected_components(e)


_NAMES = "names AS (SELECT DISTINCT 'app.' || replace(p_type, ' ', '.') AS importer, 'lib.' || replace(p_brand, '#', '.b') AS imported FROM part)"


@query(
    f"""WITH {_NAMES}, rules AS (SELECT * FROM (VALUES ('app', 'lib.Brand.b1'), ('app.PROMO', 'lib.Brand'), ('app.ECONOMY', 'lib')) t(source, target))
    SELECT importer, imported, source, target FROM names JOIN rules ON (importer = source OR starts_with(importer, source || '.')) AND (imported = target OR starts_with(imported, target || '.'))"""
)
def prefix_rules(spark, sf):
    """Forbidden edges."""
    e = table(spark, sf, "part").select(F.concat(F.lit("app."), F.replace("p_type", F.lit(" "), F.lit("."))).alias("importer"), F.concat(F.lit("lib."), F.replace("p_brand", F.lit("#"), F.lit(".b"))).alias("imported"))
    rules = spark.createDataFrame([("app", "lib.Brand.b1"), ("app.PROMO", "lib.Brand"), ("app.ECONOMY", "lib")], "source string, target string")
    return graph.policy_violations(e, rules)


@query(
    """WITH p AS (SELECT DISTINCT replace(p_type, ' ', '/') AS path FROM part), b AS (SELECT * FROM (VALUES ('promo', 'PROMO'), ('plated', 'PROMO/PLATED'), ('std', 'STANDARD'), ('alt', 'STANDARD')) t(name, prefix)),
    m AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC, name) AS k FROM p JOIN b ON path = prefix OR starts_with(path, prefix || '/')) SELECT p.path AS path, m.name AS boundary FROM p LEFT JOIN m ON m.path = p.path AND k = 1"""
)
def boundary_assignment(spark, sf):
    """Longest prefix."""
    p = table(spark, sf, "part").select(F.replace("p_type", F.lit(" "), F.lit("/")).alias("path"))
    b = spark.createDataFrame([("promo", "PROMO"), ("plated", "PROMO/PLATED"), ("std", "STANDARD"), ("alt", "STANDARD")], "name string, prefix string")
    return architecture.assign_boundaries(p, b)


@query(
    """SELECT o_custkey AS id, CASE WHEN count(*) FILTER (o_orderpriority = '5-LOW') > 0 THEN 'unknown' WHEN count(DISTINCT o_orderstatus) = 1 THEN 'within' ELSE 'cross' END AS relation FROM orders GROUP BY 1"""
)
def boundary_relations(spark, sf):
    """E27."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("boundary"))
    return architecture.boundary_relation(o, ["id"])


@query(
    """WITH i AS (SELECT user_id, max(floor(epoch(ts))) AS t FROM events WHERE event_type = 'view' GROUP BY 1), d AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_type = 'error')
    SELECT event_id, CASE WHEN t IS NULL OR ts < CAST(t AS BIGINT) THEN 'unresolved' WHEN ts - CAST(t AS BIGINT) <= 14 * 86400 THEN 'recent' ELSE 'outside-window' END AS state,
      CASE WHEN t IS NULL THEN 'unknown-introduction' WHEN ts < CAST(t AS BIGINT) THEN 'timestamp-order' END AS reason, CASE WHEN ts >= CAST(t AS BIGINT) THEN ts - CAST(t AS BIGINT) END AS age_seconds FROM d LEFT JOIN i USING (user_id)"""
)
def rework(spark, sf):
    """Errors as deletions of a line that a user's last view has introduced."""
    e = table(spark, sf, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    line = {"language": F.lit("x"), "cohort": F.lit("production"), "path": F.col("user_id").cast("string"), "line": F.lit(1)}
    origins = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("s").alias("origin_ts")).withColumns(line)
    deleted = e.filter("event_type = 'error'").withColumns(line).select("event_id", "language", "cohort", "path", "line", F.col("s").alias("ts"))
    return history.classify_deletions(deleted, origins).select("event_id", "state", "reason", "age_seconds")


@query(
    """WITH s AS (SELECT event_type AS language, user_id, CAST(count(*) AS BIGINT) AS a, CAST(sum(event_id % 3) AS BIGINT) AS d FROM events GROUP BY 1, 2)
    SELECT language, CASE WHEN language = 'view' THEN 'unavailable' ELSE 'measured' END AS state, CASE WHEN language <> 'view' THEN CAST(sum(a) AS BIGINT) END AS added, CASE WHEN language <> 'view' THEN CAST(sum(d) AS BIGINT) END AS deleted,
      CASE WHEN language <> 'view' THEN CAST(sum(a + d) AS BIGINT) END AS churn, CASE WHEN language <> 'view' THEN CAST(sum(a - d) AS BIGINT) END AS net FROM s GROUP BY language"""
)
def history_totals(spark, sf):
    """E24."""
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("language"), "user_id").agg(F.count(F.lit(1)).alias("added"), F.sum(F.col("event_id") % 3).alias("deleted"))
    rows = s.withColumns({"cohort": F.lit("production"), "revision": F.col("user_id").cast("string"), "failed": F.col("language") == "view"})
    return history.history_totals(rows).drop("cohort")


@query(
    """WITH RECURSIVE c AS (SELECT event_id AS revision, event_id - 1 - event_id % 3 AS parent, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), w(revision, parent, t, depth) AS (SELECT *, 0 FROM c WHERE revision = 900 UNION ALL SELECT c.revision, c.parent, c.t, w.depth + 1 FROM w JOIN c ON c.revision = w.parent WHERE w.depth + 1 < 40)
    SELECT CAST(revision AS VARCHAR) AS revision, CAST(max(depth) OVER () - depth AS INTEGER) AS step, CASE WHEN depth = 39 THEN 'commit-limit' END AS boundary FROM w"""
)
def commit_chain(spark, sf):
    """Events as commits, each with an earlier one as its parent."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("revision"), (F.col("event_id") - 1 - F.col("event_id") % 3).cast("string").alias("parent"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"))
    return history.commit_chain(e, "900", max_commits=40).select("revision", "step", "boundary")
