"""More operators on the shared test tables, each beside the same computation in plain SQL: changes, coverage, scores, reviews,
checks.  See ``table_queries`` for the roles that columns take; importing this module adds to its registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architecture, checks, continuity, coverage, evidence, matching, ranking, reviews, scoring
from ..session import table
from .table_queries import LINES, ORACLES, QUERIES, WITHOUT_SQL, doc_files, doc_lines, query

__all__ = ["ORACLES", "QUERIES", "WITHOUT_SQL"]

# --- two snapshots: even keys are the old side, odd ones the new ----------------------------------------------------------


def _split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col(key) % 2 == 0), rows.filter(F.col(key) % 2 == 1)


def _symbol_sql() -> str:
    """The passes one after another: what a pass settles is gone from both sides."""
    population, steps = "language, cohort", []
    passes = [
        ("single", "path, kind, name", "named"), ("single", "kind, name, ast", "moved"), ("both", "kind, name, ast", "competing-move-candidates"),
        ("both", "kind, rename", "possible-declaration-rename"), ("both", "kind, name", "possible-move-and-edit"),
    ]
    bad = "path IN ('f3', 'f8')"
    many = f"({population}, path, kind, name) IN (SELECT {population}, path, kind, name FROM s WHERE NOT {bad} GROUP BY {population}, path, kind, name, side HAVING count(*) > 1)"
    out = [f"SELECT 'unresolved' AS state, occ, CASE WHEN {bad} THEN 'source-unavailable' ELSE 'duplicate-qualified-name' END AS reason FROM s WHERE {bad} OR {many}"]
    steps.append(f"r0 AS (SELECT * FROM s WHERE NOT ({bad}) AND NOT {many})")
    for k, (how, keys, what) in enumerate(passes):
        limit = " AND count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1" if how == "single" else ""
        steps.append(f"k{k} AS (SELECT {population}, {keys} FROM r{k} GROUP BY {population}, {keys} HAVING count(DISTINCT side) = 2{limit})")
        hit = f"({population}, {keys}) IN (SELECT * FROM k{k})"
        if how == "single":
            state = "CASE WHEN a.ast <> b.ast THEN 'modified' WHEN a.path = b.path THEN 'unchanged' ELSE 'moved' END"
            steps.append(f"p{k} AS (SELECT {state} AS state, a.occ AS a, b.occ AS b FROM r{k} a JOIN r{k} b USING ({population}, {keys}) WHERE a.side = 0 AND b.side = 1 AND ({population}, {keys}) IN (SELECT * FROM k{k}))")
            out.append(f"SELECT state, unnest([a, b]), NULL FROM p{k}")
        else:
            out.append(f"SELECT 'unresolved', occ, '{what}' FROM r{k} WHERE {hit}")
        steps.append(f"r{k + 1} AS (SELECT * FROM r{k} WHERE NOT {hit})")
    last = f"r{len(passes)}"
    lacking = "cohort = 'O' AND side = 0"
    out.append(f"SELECT CASE WHEN {lacking} THEN 'unresolved' WHEN side = 0 THEN 'removed' ELSE 'added' END, occ, CASE WHEN {lacking} THEN 'counterpart-source-unavailable' END FROM {last}")
    source = (
        "s AS (SELECT CAST(o_orderkey AS VARCHAR) AS occ, o_orderkey % 2 AS side, o_orderpriority AS language, o_orderstatus AS cohort, 'f' || (o_custkey % 40) AS path, 'k' || (o_custkey % 2) AS kind, "
        "'n' || (o_orderkey // 2 % 50) AS name, 'a' || (o_custkey % 7) AS ast, 'r' || (o_orderkey // 3 % 400) AS rename FROM orders)"
    )
    return f"WITH {source}, {', '.join(steps)} {' UNION ALL '.join(out)}"


@query(_symbol_sql())
def symbol_changes(spark, sf):
    """Orders as declarations."""
    s = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("occ"), F.col("o_orderpriority").alias("language"), F.col("o_orderstatus").alias("cohort"), F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("path"),
        F.concat(F.lit("k"), F.col("o_custkey") % 2).alias("kind"), F.concat(F.lit("n"), F.expr("o_orderkey div 2 % 50")).alias("name"), F.concat(F.lit("a"), F.col("o_custkey") % 7).alias("ast"), F.concat(F.lit("r"), F.expr("o_orderkey div 3 % 400")).alias("rename"),
    )
    old, new = (x.drop("o_orderkey") for x in _split(s, "o_orderkey"))
    bad = s.filter("path IN ('f3', 'f8')").select("language", "cohort", "path")
    lacking = s.filter("cohort = 'O'").select("language", "cohort")
    got = continuity.symbol_changes(old, new, unavailable_paths=bad, incomplete_new=lacking)
    return got.select("state", F.explode(F.array_compact(F.array("old_occ", "new_occ"))).alias("occ"), "reason")


_EVENT = "e AS (SELECT event_id, CAST(event_id AS VARCHAR) AS occ, event_id % 2 AS side, 'p' || (user_id % 7) AS pair, 's' || (user_id % 5) || event_type AS symbol, 'g' || (CAST(floor(value) AS BIGINT) % 3) AS signature, value < 3 AS unsure, value > 60 AS found FROM events)"


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("event_id").cast("string").alias("occ"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("pair"), F.concat(F.lit("s"), F.col("user_id") % 5, "event_type").alias("symbol"),
        F.concat(F.lit("g"), F.floor("value") % 3).alias("signature"), F.when(F.col("value") < 3, "unresolved").otherwise("assessed").alias("state"), (F.col("value") > 60).alias("found"),
    )


@query(
    f"""WITH {_EVENT}, f AS (SELECT * FROM e WHERE found), known AS (SELECT DISTINCT pair, symbol, side FROM e), shared AS (SELECT pair, symbol FROM known GROUP BY 1, 2 HAVING count(*) = 2),
    churn AS (SELECT pair FROM known WHERE (pair, symbol) NOT IN (SELECT * FROM shared) GROUP BY 1 HAVING count(DISTINCT side) = 2), unsure AS (SELECT DISTINCT pair, symbol FROM e WHERE unsure),
    m AS (SELECT * FROM f WHERE (pair, symbol) IN (SELECT * FROM shared) AND (pair, symbol) NOT IN (SELECT * FROM unsure)),
    k AS (SELECT pair, symbol, signature FROM m GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1), r AS (SELECT * FROM m WHERE (pair, symbol, signature) NOT IN (SELECT * FROM k)),
    g AS (SELECT pair, symbol, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM r GROUP BY 1, 2)
    SELECT occ, 'persisted' AS state FROM m WHERE (pair, symbol, signature) IN (SELECT * FROM k)
    UNION ALL SELECT occ, CASE WHEN a = 1 AND b = 1 THEN 'changed' WHEN a > 0 AND b > 0 THEN 'unresolved' WHEN side = 0 THEN 'removed' ELSE 'introduced' END FROM r JOIN g USING (pair, symbol)
    UNION ALL SELECT occ, 'unresolved' FROM f WHERE (pair, symbol) IN (SELECT * FROM shared) AND (pair, symbol) IN (SELECT * FROM unsure)
    UNION ALL SELECT occ, CASE WHEN pair IN (SELECT * FROM churn) THEN 'unresolved' WHEN side = 0 THEN 'removed' ELSE 'introduced' END FROM f WHERE (pair, symbol) NOT IN (SELECT * FROM shared)"""
)
def error_changes(spark, sf):
    """Events as handlers."""
    old, new = _split(_event_rows(spark, sf), "event_id")
    got = continuity.error_changes(old.filter("found"), new.filter("found"), old, new)
    return got.select(F.explode(F.array_compact(F.array("old_occ", "new_occ"))).alias("occ"), "state")


@query(
    f"""WITH {_EVENT}, k AS (SELECT pair, symbol, signature FROM e GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1), r AS (SELECT * FROM e WHERE (pair, symbol, signature) NOT IN (SELECT * FROM k)),
    j AS (SELECT pair, symbol FROM r GROUP BY 1, 2 HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1), q AS (SELECT * FROM r WHERE (pair, symbol) NOT IN (SELECT * FROM j)), b AS (SELECT pair FROM q GROUP BY 1 HAVING count(DISTINCT side) = 2)
    SELECT occ, 'persisted' AS state FROM e WHERE (pair, symbol, signature) IN (SELECT * FROM k) UNION ALL SELECT occ, 'changed' FROM r WHERE (pair, symbol) IN (SELECT * FROM j)
    UNION ALL SELECT occ, CASE WHEN pair IN (SELECT * FROM b) THEN 'unresolved' WHEN side = 0 THEN 'removed' ELSE 'introduced' END FROM q"""
)
def dispatch_changes(spark, sf):
    """Events as state comparisons."""
    rows = _event_rows(spark, sf).withColumns({"subject": F.lit("x"), "context": F.lit("condition"), "operator": F.lit("eq"), "values": F.array("signature")})
    got = continuity.dispatch_changes(*_split(rows, "event_id"))
    return got.select(F.explode(F.array_compact(F.array("old_occ", "new_occ"))).alias("occ"), "state")


@query(
    """WITH o AS (SELECT o_orderkey AS occ, o_orderkey % 2 AS side, o_custkey AS path, 1 + o_orderkey // 2 % 3 AS line FROM orders), n AS (SELECT path, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM o GROUP BY 1),
    x AS (SELECT p.occ AS a, q.occ AS b FROM o p JOIN o q USING (path, line) JOIN n USING (path) WHERE p.side = 0 AND q.side = 1 AND (n.a > 1 OR n.b > 1))
    SELECT p.occ AS old_occ, q.occ AS new_occ FROM o p JOIN o q USING (path) JOIN n USING (path) WHERE p.side = 0 AND q.side = 1 AND n.a = 1 AND n.b = 1
    UNION ALL SELECT a, b FROM x WHERE a IN (SELECT a FROM x GROUP BY 1 HAVING count(*) = 1) AND b IN (SELECT b FROM x GROUP BY 1 HAVING count(*) = 1)"""
)
def member_matches(spark, sf):
    """Orders as members of duplicates, in files that keep their lines under another name."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("occ"), F.col("o_custkey").cast("string").alias("path"), F.expr("cast(1 + o_orderkey div 2 % 3 AS int)").alias("start_line")).withColumn("end_line", F.col("start_line"))
    old, new = (x.drop("o_orderkey") for x in _split(o, "o_orderkey"))
    new = new.withColumn("path", F.concat(F.lit("to/"), "path"))
    files = o.select(F.col("path").alias("old_path"), F.concat(F.lit("to/"), "path").alias("new_path")).distinct()
    lines = files.select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("old_line")).withColumn("new_line", F.col("old_line"))
    return continuity.match_members(old, new, files, lines)


@query(
    """WITH p AS (SELECT o_orderkey AS a, o_custkey AS b, o_orderpriority <> '5-LOW' AS same, 1 + o_custkey % 6 AS n FROM orders), x AS (SELECT l_orderkey AS a, count(*) AS k, count(DISTINCT l_returnflag || l_linestatus) AS kinds FROM lineitem GROUP BY 1)
    SELECT CAST(p.a AS BIGINT) AS old_occ, CAST(p.b AS BIGINT) AS new_occ, CASE WHEN NOT same OR k IS NULL THEN 'unrelated' WHEN 2 * k > n AND kinds >= 2 THEN 'anchored' ELSE 'uncertain' END AS relation FROM p LEFT JOIN x USING (a)"""
)
def edited_relations(spark, sf):
    """Lineitems as anchored statements of orders."""
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("old_occ"), F.col("o_custkey").alias("new_occ"), (F.col("o_orderpriority") != "5-LOW").alias("same_owner"), (1 + F.col("o_custkey") % 6).alias("statements"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("old_occ"), F.concat("l_returnflag", "l_linestatus").alias("fingerprint"))
    return continuity.anchored_relation(p, lines.join(p.select("old_occ", "new_occ"), "old_occ"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'old:' || c_nationkey AS a, 'new:' || (c_nationkey // 2) || '-' || CASE WHEN c_nationkey < 8 THEN 0 ELSE CAST(floor(c_acctbal / 6000) AS BIGINT) END AS b FROM customer),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, least) AS (SELECT a, a FROM u UNION SELECT u.b, r.least FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(least) AS component FROM r GROUP BY 1),
    n AS (SELECT component, count(*) FILTER (node LIKE 'old:%') AS a, count(*) FILTER (node LIKE 'new:%') AS b FROM c GROUP BY 1)
    SELECT component, CASE WHEN node LIKE 'old:%' THEN substr(node, 5) END AS old_group, CASE WHEN node LIKE 'new:%' THEN substr(node, 5) END AS new_group, CASE WHEN a > 1 OR b > 1 THEN 'ambiguous' ELSE 'paired' END AS resolution FROM c JOIN n USING (component)"""
)
def group_resolution(spark, sf):
    """Nations, and pairs of nations with a range of balances, as groups that customers relate."""
    mark = F.when(F.col("c_nationkey") < 8, 0).otherwise(F.floor(F.col("c_acctbal") / 6000))
    return continuity.resolve_groups(table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("old_group"), F.concat(F.expr("c_nationkey div 2"), F.lit("-"), mark).alias("new_group")))


# --- inventory and coverage -------------------------------------------------------------------------------------------------

_INVENTORY = r"""d AS (SELECT doc_id, coalesce(source, 'none') || '/' || CASE WHEN doc_id % 9 = 0 THEN 'build/' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN 'test_' ELSE 'm_' END || doc_id || '.' || coalesce(lang, 'md') AS path, lang, doc_id % 31 = 0 AS link, doc_id % 23 = 0 AS ignored, CASE WHEN doc_id % 17 = 0 THEN 'denied' END AS err, text FROM documents),
  c AS (SELECT *, CASE WHEN regexp_matches(path, '^([^/]+/)*test_[^/]*\.(en|de)$') THEN 'test' WHEN regexp_matches(path, '^([^/]+/)*[^/]*\.(en|de|fr)$') THEN 'production' END AS cohort FROM d),
  r AS (SELECT *, CASE WHEN link THEN 'symlink' WHEN regexp_matches(path, '^([^/]+/)*build(/.*)?$') THEN 'configured exclusion' WHEN ignored THEN 'git ignored' WHEN lang IS NULL THEN 'unsupported' WHEN cohort IS NULL THEN 'outside configured cohorts' WHEN err IS NOT NULL THEN 'read error' WHEN contains(text, 'Licensed under') THEN 'generated' END AS reason FROM c),
  s AS (SELECT *, CASE WHEN reason = 'read error' THEN 'failed' WHEN reason = 'unsupported' THEN 'unsupported' WHEN reason IS NOT NULL THEN 'excluded' ELSE 'scored' END AS state FROM r)"""


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as listed files."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.expr("concat(coalesce(source, 'none'), '/', if(doc_id % 9 = 0, 'build/', ''), if(doc_id % 4 = 0, 'test_', 'm_'), doc_id, '.', coalesce(lang, 'md'))").alias("path"), F.col("lang").alias("language"),
        (F.col("doc_id") % 31 == 0).alias("is_symlink"), (F.col("doc_id") % 23 == 0).alias("git_ignored"), F.when(F.col("doc_id") % 17 == 0, "denied").alias("read_error"), F.col("text").cast("binary").alias("content"), F.col("n_chars"),
    )
    return coverage.classify(rows, production=["**/*.en", "**/*.de", "**/*.fr"], test=["**/test_*.en", "**/test_*.de"], exclusions=["**/build/**"], markers=["Licensed under"])


@query(f"WITH {_INVENTORY} SELECT doc_id, cohort, reason, state FROM s")
def inventory_states(spark, sf):
    """Why documents are scored or not."""
    return _inventory(spark, sf).select("doc_id", "cohort", "reason", "state")


@query(f"WITH {_INVENTORY} SELECT state, cohort, lang AS language, reason, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(length(text)) FILTER (state = 'scored') AS BIGINT) AS sloc FROM s GROUP BY 1, 2, 3, 4")
def inventory_coverage(spark, sf):
    """E9."""
    rows = _inventory(spark, sf)
    return coverage.coverage_counts(rows.withColumn("sloc", F.length(F.col("content").cast("string"))))


@query(
    """WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS path, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bad FROM orders GROUP BY 1), g AS (SELECT CAST(o_custkey AS VARCHAR) AS path, arg_min(o_orderpriority, o_orderkey) AS code FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT path, CASE WHEN bad = 1 THEN coalesce(code, 'parse-failed') END AS failure FROM f LEFT JOIN g USING (path)"""
)
def failure_reasons(spark, sf):
    """The first error of each customer with a failed order."""
    o = table(spark, sf, "orders").withColumn("path", F.col("o_custkey").cast("string"))
    files = o.groupBy("path").agg(F.when(F.max(F.col("o_orderstatus") == "F"), "failed").otherwise("parsed").alias("parse_state"))
    errors = o.select("path", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("warning").alias("severity"))
    return coverage.failure_reasons(files, errors).select("path", "failure")


@query(
    """WITH r AS (SELECT CASE WHEN value < 20 THEN 'unresolved' ELSE 'assessed' END AS state, event_type AS reason, value > 90 AS hit FROM events), b AS (SELECT reason, count(*) AS n FROM r WHERE state = 'unresolved' GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS encountered, CAST(count(*) FILTER (state = 'assessed') AS BIGINT) AS assessed, CAST(count(*) FILTER (state = 'unresolved') AS BIGINT) AS unresolved, CAST(count(*) FILTER (hit) AS BIGINT) AS findings,
      (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM b) AS reasons FROM r"""
)
def experiment_coverage(spark, sf):
    """E21."""
    r = table(spark, sf, "events").select(F.when(F.col("value") < 20, "unresolved").otherwise("assessed").alias("state"), F.col("event_type").alias("reason"), (F.col("value") > 90).alias("is_finding"))
    got = coverage.experimental_coverage(r)
    return got.withColumn("reasons", F.array_join(F.transform("reasons", lambda x: F.concat(x.reason, F.lit("="), x.n)), ","))


@query(
    """WITH f AS (SELECT o_orderkey, CAST(o_custkey % 4 AS VARCHAR) AS version, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'production' END AS cohort, CAST(o_totalprice / 10000 AS INTEGER) AS cc, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey % 5 END AS a FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN version IN ('1', '2') THEN cc WHEN version = '3' THEN CASE WHEN cohort = 'test' AND a IS NOT NULL THEN cc - a ELSE cc END END AS BIGINT) AS complexity FROM f"""
)
def complexity_by_version(spark, sf):
    """B11, B12.  SQL's cast takes halves to the even number, and so does rint."""
    cc, asserts = F.rint(F.col("o_totalprice") / 10000).cast("long"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 5)
    cohort = F.when(F.col("o_orderstatus") == "F", "test").otherwise("production")
    return table(spark, sf, "orders").select("o_orderkey", evidence.complexity_by_version((F.col("o_custkey") % 4).cast("string"), cohort, cc, asserts).alias("complexity"))


# --- imports, sides and rankings ---------------------------------------------------------------------------------------------


@query(
    """WITH ix AS (SELECT replace(p_type, ' ', '.') AS module, CASE WHEN count(*) > 12 THEN 2 ELSE 1 END AS kind FROM part GROUP BY 1), tops AS (SELECT DISTINCT split_part(module, '.', 1) AS top FROM ix),
    i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'os.' || l_returnflag WHEN l_linenumber = 5 THEN 'PROMO.' || l_linestatus ELSE replace(p_type, ' ', '.') END AS target FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN target IS NULL OR kind = 2 THEN 'unresolved' WHEN kind = 1 THEN 'internal' WHEN top IS NOT NULL THEN 'unresolved' ELSE 'external' END AS state,
      CASE WHEN target IS NULL THEN 'relative-beyond-root' WHEN kind = 2 THEN 'ambiguous' WHEN kind = 1 THEN NULL WHEN top IS NOT NULL THEN 'missing-internal' END AS reason, CASE WHEN kind = 1 THEN target END AS imported
    FROM i LEFT JOIN ix ON module = target LEFT JOIN tops ON top = split_part(target, '.', 1)"""
)
def import_resolution(spark, sf):
    """Lineitems as imports of part types."""
    module = F.replace("p_type", F.lit(" "), F.lit("."))
    parts = table(spark, sf, "part")
    index = parts.groupBy(module.alias("module")).agg(F.when(F.count(F.lit(1)) > 12, "ambiguous").otherwise("unique").alias("status"))
    n = F.col("l_linenumber")
    target = F.when(n == 7, None).when(n == 6, F.concat(F.lit("os."), "l_returnflag")).when(n == 5, F.concat(F.lit("PROMO."), "l_linestatus")).otherwise(module)
    imports = table(spark, sf, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", target.alias("target"))
    return architecture.resolve_imports(imports, index).select("l_orderkey", "l_linenumber", "state", "reason", "imported")


@query("""SELECT 'baseline' AS source, 'baseline:' || c_custkey AS id, c_mktsegment AS what FROM customer UNION ALL SELECT 'current', 'current:' || s_suppkey, s_name FROM supplier""")
def tagged_sides(spark, sf):
    """H5."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("what"))
    return matching.side_tagged(old, table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("what")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS points, CAST(row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS place FROM customer""")
def ordered_files(spark, sf):
    """The order of the table, as a column."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("points"))
    from pyspark.sql import Window

    return ranking.file_table(c).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


@query("""SELECT o_custkey AS group_id, CAST(count(*) AS BIGINT) AS lines FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def largest_groups(spark, sf):
    """G6."""
    return ranking.clone_groups_by_size(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.count(F.lit(1)).alias("lines")))


@query(
    """WITH a AS (SELECT 'nations' AS family, n_name AS name FROM nation ORDER BY n_name LIMIT 30), b AS (SELECT 'regions', r_name FROM region ORDER BY r_name LIMIT 30), t AS (SELECT 1 AS f, * FROM a UNION ALL SELECT 2, * FROM b)
    SELECT family, '{"name":"' || name || '"}' AS row FROM t ORDER BY f, name LIMIT 28"""
)
def shared_limit(spark, sf):
    """Families in turn under one limit."""
    nations, regions = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name"))
    return ranking.shared_limit([("nations", nations, ["name"]), ("regions", regions, ["name"])], 28)


@query(
    """WITH p AS (SELECT DISTINCT replace(p_type, ' ', '/') || '/' || p_partkey AS path FROM part), u AS (SELECT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS directory FROM p)
    SELECT directory, CAST(count(*) AS BIGINT) AS files, CAST(CASE WHEN directory = '' THEN 0 ELSE len(string_split(directory, '/')) END AS INTEGER) AS depth FROM u GROUP BY 1"""
)
def directories(spark, sf):
    """G10."""
    return ranking.directories(table(spark, sf, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_partkey").alias("path")))


# --- scores -------------------------------------------------------------------------------------------------------------------

_BANDS = "b AS (SELECT * FROM (VALUES (0, 10, 1.0), (10, 30, 2.0), (30, NULL, 3.0)) t(lo, hi, mark))"


@query(f"""WITH {_BANDS} SELECT p_partkey, CASE WHEN p_brand <> 'Brand#11' THEN mark END AS mark FROM part LEFT JOIN b ON p_size >= lo AND (hi IS NULL OR p_size < hi)""")
def population_bands(spark, sf):
    """Half-open bands of sizes."""
    known = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("cohort"), F.col("p_size").alias("sloc"))
    bands = spark.createDataFrame([(0, 10, [1.0]), (10, 30, [2.0]), (30, None, [3.0])], "min_sloc int, max_sloc int, values array<double>")
    cohorts = known.select("cohort").distinct().filter("cohort <> 'Brand#11'")
    got = scoring.with_population(known, cohorts.join(bands), ["cohort"])  # 25 brands by 3 bands
    return got.select("p_partkey", F.col("values")[0].alias("mark"))


@query(
    """WITH a AS (SELECT o_custkey AS id, 'm' || (o_orderkey % 3) AS metric_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 101) * 0.25 ELSE o_custkey % 101 END AS DECIMAL(20,10)) * 0.5 * 10 AS amount FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) = 1),
    f AS (SELECT *, floor(amount) AS base, amount - floor(amount) AS rest, round(sum(amount) OVER w, 0) - sum(floor(amount)) OVER w AS spare FROM a WINDOW w AS (PARTITION BY id))
    SELECT id, metric_id, CAST(base + CASE WHEN row_number() OVER (PARTITION BY id ORDER BY rest DESC, metric_id) <= spare THEN 1 ELSE 0 END AS BIGINT) AS tenths FROM f"""
)
def score_contributions(spark, sf):
    """percentiles, one of them weighted by severity, as points in tenths."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("metric_id", F.concat(F.lit("m"), F.col("o_orderkey") % 3))
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey", "metric_id").orderBy("o_orderkey"))).filter("k = 1")
    rows = o.select(
        F.col("o_custkey").alias("id"), "metric_id", (F.col("o_custkey") % 101).cast(scoring.DECIMAL).alias("percentile"), F.lit(0.25).alias("raw"), F.lit(0.5).alias("weight"),
        F.when(F.col("metric_id") == "m0", "severity-weighted").otherwise("percentile").alias("transform"),
    )
    return scoring.contributions(rows, ["id"]).select("id", "metric_id", (F.col("points") * 10).cast("long").alias("tenths"))


@query(
    """WITH v AS (SELECT list_sort(list(CAST(n_regionkey AS DOUBLE))) AS v FROM nation) SELECT c_custkey, CAST(CASE WHEN c_nationkey - 4 <= 0 THEN 0 ELSE round(CAST(100 * len(list_filter(v, lambda x: x < (c_nationkey - 4) / 5.0)) AS DECIMAL(20,10)) / len(v), 1) END AS DOUBLE) AS points, CAST(len(v) AS INTEGER) AS samples, 100.0 / len(v) AS step FROM customer, v"""
)
def recorded_support(spark, sf):
    """F1, F7, F8."""
    values = F.array_sort(F.array(*[F.lit(float(r.n_regionkey)) for r in table(spark, sf, "nation").collect()]))  # 25 rows
    raw = (F.col("c_nationkey") - 4) / 5.0
    return table(spark, sf, "customer").select("c_custkey", scoring.calibrated_points(values, raw).cast("double").alias("points"), scoring.support(values).alias("s")).select("c_custkey", "points", F.col("s.sample_count").alias("samples"), F.col("s.nominal_step").alias("step"))


# --- reviews ------------------------------------------------------------------------------------------------------------------

_LEDGER = """v AS (SELECT event_id + 1 AS sequence, 'r' || user_id AS review_id, CASE WHEN user_id % 9 = 0 THEN 'model' ELSE 'clone' END AS kind, event_type AS disposition, 'e' || (event_id % 3) AS evidence, 'b' || (event_id % 2) AS boundary, CASE WHEN value > 150 THEN 'l' || (user_id % 11) END AS legacy FROM events)"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("sequence"), F.concat(F.lit("r"), "user_id").alias("review_id"), F.when(F.col("user_id") % 9 == 0, "model").otherwise("clone").alias("kind"), F.lit("python").alias("language"), F.lit("production").alias("cohort"),
        F.col("event_type").alias("disposition"), F.concat(F.lit("e"), F.col("event_id") % 3).alias("evidence_fingerprint"), F.array(F.lit("h")).alias("source_hashes"), F.concat(F.lit("b"), F.col("event_id") % 2).alias("boundary"), F.lit("a").alias("analysis_fingerprint"),
        F.when(F.col("value") > 150, F.concat(F.lit("l"), F.col("user_id") % 11)).alias("supersedes_legacy_id"),
    )


@query(f"""WITH {_LEDGER} SELECT review_id, max(sequence) AS sequence, arg_max(disposition, sequence) AS disposition FROM v GROUP BY 1""")
def latest_reviews(spark, sf):
    """F11, N5."""
    return reviews.latest(_ledger(spark, sf)).select("review_id", "sequence", "disposition")


@query(
    f"""WITH {_LEDGER}, l AS (SELECT review_id, max(sequence) AS sequence, arg_max(disposition, sequence) AS disposition, arg_max(kind, sequence) AS kind, arg_max(evidence, sequence) AS evidence, arg_max(boundary, sequence) AS boundary FROM v GROUP BY 1),
    t AS (SELECT 'r' || CAST(c_custkey AS VARCHAR) AS review_id, 'e' || (c_custkey % 3) AS evidence, 'b' || (c_custkey % 2) AS boundary FROM customer),
    j AS (SELECT l.*, t.review_id IS NOT NULL AS there, concat_ws(',', CASE WHEN l.evidence <> t.evidence THEN 'evidence' END, CASE WHEN l.boundary <> t.boundary THEN 'boundary' END) AS causes FROM l LEFT JOIN t USING (review_id))
    SELECT review_id, sequence, disposition, CASE WHEN kind <> 'clone' THEN 'not-in-selected-report' WHEN NOT there THEN 'missing' WHEN causes <> '' THEN 'stale' ELSE 'current' END AS state, CASE WHEN kind = 'clone' AND there THEN causes ELSE '' END AS causes FROM j"""
)
def review_states(spark, sf):
    """Customers as present targets."""
    c = table(spark, sf, "customer")
    present = c.select(
        F.concat(F.lit("r"), "c_custkey").alias("review_id"), F.concat(F.lit("e"), F.col("c_custkey") % 3).alias("evidence_fingerprint"), F.array(F.lit("h")).alias("source_hashes"), F.concat(F.lit("b"), F.col("c_custkey") % 2).alias("boundary"),
        F.lit("a").alias("analysis_fingerprint"), F.lit(None).cast("string").alias("unavailable"),
    )
    got = reviews.resolve(_ledger(spark, sf), present, "snapshot")
    return got.withColumn("causes", F.array_join("causes", ","))


@query(f"""WITH {_LEDGER} SELECT legacy AS supersedes_legacy_id, min(sequence) AS sequence, arg_min(review_id, sequence) AS review_id FROM v WHERE legacy IS NOT NULL GROUP BY 1""")
def superseded_reviews(spark, sf):
    """N6."""
    return reviews.superseded(_ledger(spark, sf))


@query(f"""WITH {_LEDGER} SELECT 'legacy-history' AS rule, legacy AS subject FROM v WHERE legacy IS NOT NULL GROUP BY 2 HAVING count(DISTINCT review_id) > 1""")
def ledger_rules(spark, sf):
    """Sequence, families and legacy histories."""
    return reviews.ledger_violations(_ledger(spark, sf))


@query(
    """WITH g AS (SELECT 'g' || o_custkey AS group_id, o_orderstatus AS language, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS paths FROM orders GROUP BY 1, 2), d AS (SELECT 'd' || group_id || language AS decision_id, CASE WHEN language = 'F' THEN group_id END AS group_id, language, paths FROM g)
    SELECT DISTINCT decision_id, group_id FROM (SELECT d.decision_id, g.group_id FROM d JOIN g ON g.group_id = d.group_id UNION ALL SELECT d.decision_id, g.group_id FROM d JOIN g ON g.language = d.language AND g.paths = d.paths AND d.language = 'P')"""
)
def legacy_reviews(spark, sf):
    """By id, and by equal sets of paths."""
    g = table(spark, sf, "orders").groupBy(F.concat(F.lit("g"), "o_custkey").alias("group_id"), F.col("o_orderstatus").alias("language")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("paths")).withColumn("cohort", F.lit("production"))
    d = g.select(F.concat(F.lit("d"), "group_id", "language").alias("decision_id"), F.when(F.col("language") == "F", F.col("group_id")).alias("group_id"), "language", F.when(F.col("language") == "P", F.col("cohort")).alias("cohort"), "paths")
    return reviews.legacy_matches(d, g)


@query("""SELECT n_nationkey AS k, 'nation' AS what FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, 'region' FROM region""")
def upserted(spark, sf):
    """Rows of one key replaced."""
    old = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("what"))
    return reviews.upsert(old, table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.lit("region").alias("what")), "k")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def selected_targets(spark, sf):
    """B17."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("cohort"), F.col("o_custkey").alias("evidence_fingerprint"))
    hot = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("evidence_fingerprint"))
    return evidence.select_targets(t, kinds=["1-URGENT", "2-HIGH"], cohort="F", hotspots=hot).select("id")


# --- constraints ----------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber % 3 AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_keys(spark, sf):
    """M2, M8."""
    return checks.repeated_keys(table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("k")), ["l_orderkey", "k"])


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def orphan_rows(spark, sf):
    """D5."""
    return checks.orphans(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query(f"""WITH {LINES} SELECT DISTINCT d.path, CAST(s AS INTEGER) AS start_line, CAST(s + 1 AS INTEGER) AS end_line FROM (SELECT DISTINCT path FROM lines) d, (VALUES (1), (3), (9)) t(s) WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = d.path AND l.line BETWEEN s AND s + 1)""")
def empty_spans(spark, sf):
    """M1."""
    lines = doc_lines(spark, sf).select("path", "line")
    spans = lines.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, (1, 3, 9)))).alias("start_line")).withColumn("end_line", F.col("start_line") + 1)
    return checks.spans_without_lines(spans, lines, ["path"])


@query("""WITH t AS (SELECT l_orderkey AS id, CAST(sum(l_quantity) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS d, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1) SELECT id FROM t WHERE a - d <> a - n OR a > 100 + a - n OR d > 100""")
def uneven_deltas(spark, sf):
    """M3."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("added"), F.count(F.lit(1)).alias("deleted"), F.sum("l_linenumber").alias("n"))
    t = t.select("id", "added", "deleted", (F.col("added") - F.col("n")).alias("net"), F.lit(100).alias("baseline_sloc")).withColumn("current_sloc", F.col("baseline_sloc") + F.col("net"))
    return checks.line_delta_violations(t).select("id")


@query(f"""WITH {LINES}, f AS (SELECT DISTINCT path, language, cohort FROM lines), p AS (SELECT *, CASE WHEN len(path) % 2 = 0 THEN 2 ELSE 0 END AS n FROM f WHERE cohort = 'test' UNION ALL SELECT *, 1 FROM f WHERE cohort <> 'test') SELECT path FROM p WHERE n <> 1""")
def unpaired_files(spark, sf):
    """M4."""
    f = doc_files(spark, sf)
    once = f.filter("cohort <> 'test' OR length(path) % 2 = 0")
    pairs = once.unionByName(f.filter("cohort = 'test' AND length(path) % 2 = 0")).withColumnRenamed("path", "current_path")
    return checks.unpaired_files(f, pairs, "current_path").select("path")


@query("""WITH s AS (SELECT o_custkey AS id, CAST(count(*) AS DECIMAL(10,1)) AS points FROM orders GROUP BY 1), c AS (SELECT o_custkey AS id, CAST(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 2 END) AS DECIMAL(10,1)) AS parts FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT id FROM s LEFT JOIN c USING (id) WHERE parts IS NULL OR parts <> points""")
def unequal_scores(spark, sf):
    """M5."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    scores = o.groupBy("id").agg(F.count(F.lit(1)).cast("decimal(10,1)").alias("points"))
    parts = o.filter("o_orderstatus <> 'P'").select("id", F.when(F.col("o_orderpriority") != "5-LOW", 1).otherwise(2).cast("decimal(10,1)").alias("points"))
    return checks.score_violations(scores, parts, ["id"]).select("id")


@query("""WITH c AS (SELECT event_id AS revision, event_id - CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS parent FROM events) SELECT CAST(revision AS VARCHAR) AS revision FROM c WHERE revision > 0 AND parent <> revision - 1""")
def broken_chains(spark, sf):
    """M7."""
    c = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("revision"), (F.col("event_id") - F.when(F.col("event_type") == "error", 2).otherwise(1)).cast("string").alias("parent"), F.col("event_id").cast("int").alias("step"))
    return checks.chain_violations(c).select("revision")


@query("""WITH p AS (SELECT p_brand AS b, p_size AS lo, p_size + 1 + p_partkey % 2 AS hi FROM part) SELECT DISTINCT x.b AS cohort FROM p x JOIN p y USING (b) WHERE NOT (x.lo = y.lo AND x.hi = y.hi) AND x.lo < y.hi AND y.lo < x.hi""")
def overlapping_bands(spark, sf):
    """M6."""
    p = table(spark, sf, "part").select(F.lit("file").alias("kind"), F.col("p_brand").alias("cohort"), F.lit("full").alias("model"), F.lit("m").alias("metric_id"), F.col("p_size").alias("min_sloc"), (F.col("p_size") + 1 + F.col("p_partkey") % 2).alias("max_sloc"), F.array(F.lit(1.0)).alias("values"))
    known = p.dropna(subset=["min_sloc", "max_sloc"])  # an unknown size is no band in the SQL, and an open end to the operator
    return checks.profile_violations(known).filter("rule = 'bands'").select("cohort").distinct()
