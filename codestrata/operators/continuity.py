"""Matching of evidence between two snapshots in passes, each on what the pass before left.

Evidence rows have an ``occ`` (a key of the occurrence) on each side; a result row has ``state`` and the occurrences it
covers (``old_occ`` or ``new_occ`` null where there is none).  Whatever cannot be decided stays ``unresolved``: a missing
or failed counterpart never makes evidence introduced or removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def stable_pairs(old: DataFrame, new: DataFrame, keys: list[str], line_map: DataFrame | None = None) -> DataFrame:
    """Pairs of occurrences that only one on each side can form (D13): one old and one new in a key; where there are more,
    those whose first and last line are aligned, if that partner is the only one on both sides.

    ``line_map``: old_path, new_path, old_line, new_line of aligned lines; then both sides need path, start_line, end_line.
    Returns keys, old_occ, new_occ.
    """
    sizes = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_olds")).join(new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_news")), keys)
    single = sizes.filter("_olds = 1 AND _news = 1").select(*keys)
    a, b = old.select(*keys, F.col("occ").alias("old_occ")), new.select(*keys, F.col("occ").alias("new_occ"))
    pairs = a.join(single, keys).join(b, keys).select(*keys, "old_occ", "new_occ")
    if line_map is None:
        return pairs
    several = sizes.filter("_olds > 1 OR _news > 1").select(*keys)
    olds = old.join(several, keys, "left_semi").select(*keys, F.col("occ").alias("old_occ"), F.col("path").alias("old_path"), F.col("start_line").alias("old_start"), F.col("end_line").alias("old_end"))
    news = new.join(several, keys, "left_semi").select(*keys, F.col("occ").alias("new_occ"), F.col("path").alias("new_path"), F.col("start_line").alias("new_start"), F.col("end_line").alias("new_end"))
    starts = line_map.select("old_path", "new_path", F.col("old_line").alias("old_start"), F.col("new_line").alias("new_start"))
    ends = line_map.select("old_path", "new_path", F.col("old_line").alias("old_end"), F.col("new_line").alias("new_end"))
    moved = olds.join(starts, ["old_path", "old_start"]).join(ends, ["old_path", "new_path", "old_end"])
    aligned = moved.join(news, [*keys, "new_path", "new_start", "new_end"]).select(*keys, "old_occ", "new_occ").distinct()
    return pairs.unionByName(mutual(aligned, keys))


def mutual(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs in which each occurrence has no other partner."""
    a = F.count(F.lit(1)).over(Window.partitionBy(*keys, "old_occ"))
    b = F.count(F.lit(1)).over(Window.partitionBy(*keys, "new_occ"))
    return pairs.withColumn("_a", a).withColumn("_b", b).filter("_a = 1 AND _b = 1").drop("_a", "_b")


def residue(rows: DataFrame, used: DataFrame, column: str) -> DataFrame:
    return rows.join(used.select(F.col(column).alias("occ")), "occ", "left_anti")


def _alone(rows: DataFrame, column: str, state) -> DataFrame:
    """Rows as results with an occurrence on one side only."""
    empty = "new_occ" if column == "old_occ" else "old_occ"
    state = F.lit(state) if isinstance(state, str) else state
    return rows.select(state.alias("state"), F.col("occ").alias(column), F.lit(None).cast(rows.schema["occ"].dataType).alias(empty))


def on_both_sides(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of either side whose key the other side has too."""
    shared = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys)
    return old.join(shared, keys, "left_semi"), new.join(shared, keys, "left_semi")


def _leftovers(old: DataFrame, new: DataFrame, group: list[str], unusable_old: DataFrame | None, unusable_new: DataFrame | None) -> DataFrame:
    """What no pass has paired: evidence whose counterpart could not be assessed is unresolved; of the rest, what a group has
    on both sides is unresolved, else it is removed or introduced."""
    out = []
    if unusable_old is not None:
        out.append(_alone(old.join(unusable_old.select("occ"), "occ", "left_semi"), "old_occ", "unresolved"))
        old = old.join(unusable_old.select("occ"), "occ", "left_anti")
    if unusable_new is not None:
        out.append(_alone(new.join(unusable_new.select("occ"), "occ", "left_semi"), "new_occ", "unresolved"))
        new = new.join(unusable_new.select("occ"), "occ", "left_anti")
    both_old, both_new = on_both_sides(old, new, group)
    out += [_alone(both_old, "old_occ", "unresolved"), _alone(both_new, "new_occ", "unresolved")]
    out += [_alone(old.join(both_old, "occ", "left_anti"), "old_occ", "removed"), _alone(new.join(both_new, "occ", "left_anti"), "new_occ", "introduced")]
    return reduce(DataFrame.unionByName, out)


def cascade(old: DataFrame, new: DataFrame, passes: list[tuple[list[str], str]], group: list[str], *, line_map: DataFrame | None = None, unusable_old: DataFrame | None = None, unusable_new: DataFrame | None = None) -> DataFrame:
    """Passes of ``stable_pairs`` with falling keys and the state each gives, then the leftovers by ``group``.  Aligned lines
    decide in the first pass only: what is left after it differs, and pairs only where it is single.

    Both sides and the pairs of each pass are written down, for every pass uses those before it several times over.
    """
    shared_dir(old.sparkSession)
    old, new = old.checkpoint(), new.checkpoint()
    out = None
    for k, (keys, state) in enumerate(passes):
        has_keys = " AND ".join(f"{key} IS NOT NULL" for key in keys)
        pairs = stable_pairs(old.filter(has_keys), new.filter(has_keys), keys, None if k else line_map).select(F.lit(state).alias("state"), "old_occ", "new_occ").checkpoint()
        old, new = residue(old, pairs, "old_occ").checkpoint(), residue(new, pairs, "new_occ").checkpoint()
        out = pairs if out is None else out.unionByName(pairs)
    rest = _leftovers(old, new, group, unusable_old, unusable_new)
    return rest if out is None else out.unionByName(rest)


def pattern_changes(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Continuity of findings (D14): equal rule, scope and statement persist; else one of a rule in a named scope on each
    side is changed; else a rule that is left on both sides of a pair of files is unresolved.

    Rows: occ, pair (key of the matched files), rule_id, scope ('' at module level), statement.
    """
    named = F.when(F.col("scope") != "", F.col("scope"))
    old, new = old.withColumn("named_scope", named), new.withColumn("named_scope", named)
    passes = [(["pair", "rule_id", "scope", "statement"], "persisted"), (["pair", "rule_id", "named_scope"], "changed")]
    return cascade(old, new, passes, ["pair", "rule_id"], **options)


def error_changes(old: DataFrame, new: DataFrame, old_handlers: DataFrame, new_handlers: DataFrame, *, unusable_old: DataFrame | None = None, unusable_new: DataFrame | None = None, line_map: DataFrame | None = None) -> DataFrame:
    """Continuity of fallback handlers (D15), by symbol.

    Rows: occ, pair, symbol, signature.  ``old_handlers``, ``new_handlers``: pair, symbol, state of all handlers, those without
    a fallback too; they tell which symbols a side knows.  In a symbol that both sides know, an unresolved handler on either
    side makes all unresolved; else equal signatures persist (several of one by aligned lines), single leftovers on both
    sides are changed, and others are unresolved, removed or introduced by what the symbol has left.  Findings of symbols that
    one side alone knows are removed or introduced, unless symbols of that pair of files both vanished and appeared: then they
    are unresolved.
    """
    shared_dir(old.sparkSession)
    symbol = ["pair", "symbol"]
    known = [h.select(*symbol).distinct() for h in (old_handlers, new_handlers)]
    unsure = old_handlers.filter("state = 'unresolved'").select(*symbol).union(new_handlers.filter("state = 'unresolved'").select(*symbol)).distinct()
    churn = known[0].join(known[1], symbol, "left_anti").select("pair").distinct().join(known[1].join(known[0], symbol, "left_anti").select("pair").distinct(), "pair")
    out, sides = [], []
    for rows, other, column, state, unusable in ((old, known[1], "old_occ", "removed", unusable_old), (new, known[0], "new_occ", "introduced", unusable_new)):
        if unusable is not None:
            out.append(_alone(rows.join(unusable.select("occ"), "occ", "left_semi"), column, "unresolved"))
            rows = rows.join(unusable.select("occ"), "occ", "left_anti")
        lone = rows.join(other, symbol, "left_anti").join(churn.withColumn("churn", F.lit(True)), "pair", "left")
        out.append(_alone(lone, column, F.when(F.col("churn"), "unresolved").otherwise(state)))
        rows = rows.join(other, symbol, "left_semi")
        out.append(_alone(rows.join(unsure, symbol, "left_semi"), column, "unresolved"))
        sides.append(rows.join(unsure, symbol, "left_anti"))
    matched = cascade(*sides, [([*symbol, "signature"], "persisted"), (symbol, "changed")], symbol, line_map=line_map)
    return reduce(DataFrame.unionByName, out, matched)


def dispatch_changes(old: DataFrame, new: DataFrame, **options) -> DataFrame:
    """Continuity of state comparisons (D16): by full signature, then by site (symbol, subject, context)."""
    full = ["pair", "symbol", "subject", "context", "operator", "values"]
    return cascade(old, new, [(full, "persisted"), (["pair", "symbol", "subject", "context"], "changed")], ["pair"], **options)


def symbol_changes(old: DataFrame, new: DataFrame, *, unavailable_paths: DataFrame | None = None, incomplete_old: DataFrame | None = None, incomplete_new: DataFrame | None = None) -> DataFrame:
    """Declarations of two snapshots (D17): ``state, old_occ, new_occ, reason``; an unresolved occurrence has a row of its own.

    Rows: occ, language, cohort, path (the matched file's current path where files are paired), kind, name, ast (exact
    fingerprint), rename (fingerprint without the name), and optionally place (the path in its own snapshot).  In order: files
    that could not be read are unresolved; names that occur several times in a file on a side are unresolved; equal names are
    unchanged (moved, where their place differs) or modified; equal names and syntax in other files are moved where single,
    else unresolved; then all that share their syntax but for the name, and all that share their name, are unresolved on both
    sides; so is what is left of a language and cohort whose other side is incomplete (``incomplete_old`` and ``_new``: those
    in which the old, the new snapshot lacks files).  The rest is removed or added.
    """
    shared_dir(old.sparkSession)
    population, columns = ["language", "cohort"], ["occ", "language", "cohort", "path", "kind", "name", "ast", "rename"]
    sides = [x.select(*columns, (F.col("place") if "place" in x.columns else F.col("path")).alias("place"), F.lit(k).alias("side")) for k, x in enumerate((old, new))]
    none = F.lit(None).cast("string")
    # One table of both sides, whose rows get their state pass by pass.
    rows = sides[0].unionByName(sides[1]).select("*", none.alias("state"), F.lit(None).cast(old.schema["occ"].dataType).alias("partner"), none.alias("reason"))
    is_open = F.col("state").isNull()

    def settled(keys: list[str], found: DataFrame, state, partner=None, reason=None) -> None:
        """Open rows whose key is found get a state; ``found`` has each key once, further columns, and ``_hit``."""
        nonlocal rows
        more = [c for c in found.columns if c not in keys]
        hit = is_open & F.coalesce("_hit", F.lit(False))
        values = {"state": state, "partner": F.lit(None) if partner is None else partner, "reason": none if reason is None else reason}
        rows = rows.join(found, keys, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop(*more).checkpoint()

    def on_both(keys: list[str], single: bool) -> DataFrame:
        counts = [F.count(F.when(F.col("side") == k, 1)).alias(f"_n{k}") for k in (0, 1)]
        facts = [F.max(F.when(F.col("side") == k, F.struct("occ", "ast", "place"))).alias(f"_x{k}") for k in (0, 1)] if single else []
        return rows.filter(is_open).groupBy(*keys).agg(*counts, *facts).filter("_n0 = 1 AND _n1 = 1" if single else "_n0 > 0 AND _n1 > 0").withColumn("_hit", F.lit(True))

    def paired(keys: list[str]) -> None:
        state = F.when(F.col("_x0.ast") != F.col("_x1.ast"), "modified").when(F.col("_x0.place") == F.col("_x1.place"), "unchanged").otherwise("moved")
        settled(keys, on_both(keys, True), state, F.when(F.col("side") == 0, F.col("_x1.occ")).otherwise(F.col("_x0.occ")))

    unresolved = F.lit("unresolved")
    if unavailable_paths is not None:
        keys = [*population, "path"]
        settled(keys, unavailable_paths.select(*keys).distinct().withColumn("_hit", F.lit(True)), unresolved, reason=F.lit("source-unavailable"))
    by_name = [*population, "path", "kind", "name"]
    many = rows.filter(is_open).groupBy(*by_name, "side").count().filter("count > 1").select(*by_name).distinct().withColumn("_hit", F.lit(True))
    settled(by_name, many, unresolved, reason=F.lit("duplicate-qualified-name"))
    moves = [*population, "kind", "name", "ast"]
    paired(by_name)
    paired(moves)
    for keys, why in ((moves, "competing-move-candidates"), ([*population, "kind", "rename"], "possible-declaration-rename"), ([*population, "kind", "name"], "possible-move-and-edit")):
        settled(keys, on_both(keys, False), unresolved, reason=F.lit(why))
    lacking = [x.select(*population).distinct().withColumn("side", F.lit(k)) for k, x in enumerate((incomplete_new, incomplete_old)) if x is not None]
    if lacking:
        settled([*population, "side"], reduce(DataFrame.unionByName, lacking).withColumn("_hit", F.lit(True)), unresolved, reason=F.lit("counterpart-source-unavailable"))
    state = F.coalesce("state", F.when(F.col("side") == 0, "removed").otherwise("added"))
    first = F.col("side") == 0
    # Of a pair, the old side's row stands for both.
    return rows.filter("partner IS NULL OR side = 0").select(
        state.alias("state"), F.when(first, F.col("occ")).alias("old_occ"), F.when(first, F.col("partner")).otherwise(F.col("occ")).alias("new_occ"), "reason"
    )


def novel_ratio(changes: DataFrame, by: list[str]) -> DataFrame:
    """Added over added and modified (E17); unavailable where anything is unresolved or there is nothing to divide by."""
    counts = changes.groupBy(*by).agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("added", "modified", "unresolved")])
    total = F.col("added") + F.col("modified")
    ok = (F.col("unresolved") == 0) & (total > 0)
    return counts.select(*by, "added", "modified", "unresolved", F.when(ok, F.col("added") / total).alias("novel_ratio"), F.when(ok, "measured").otherwise("unavailable").alias("state"))


def match_members(old: DataFrame, new: DataFrame, file_map: DataFrame, line_map: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Members of duplicate blocks by mapped file: a single one on each side, else aligned ends (D18): old_occ, new_occ.

    Rows: occ, path, start_line, end_line, and the columns ``by``, in which both must agree.  ``file_map``: old_path, new_path.
    """
    by = by or []
    mapped = old.join(file_map.select(F.col("old_path").alias("path"), F.col("new_path").alias("file")).distinct(), "path").select("occ", "path", "file", "start_line", "end_line", *by)
    return stable_pairs(mapped, new.withColumn("file", F.col("path")), [*by, "file"], line_map).select("old_occ", "new_occ")


def anchored_relation(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Relation of an edited block to its possible counterpart (D19): ``anchored`` where more than half of its statements,
    and at least two different ones, have an aligned counterpart; ``uncertain`` where some have; else ``unrelated``.

    ``pairs``: old_occ, new_occ, same_owner, statements (the larger number).  ``anchors``: old_occ, new_occ, fingerprint, one
    row for each aligned statement.
    """
    found = anchors.groupBy("old_occ", "new_occ").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("kinds"))
    rows = pairs.join(found, ["old_occ", "new_occ"], "left").na.fill(0, ["n", "kinds"])
    relation = F.when(~F.col("same_owner") | (F.col("n") == 0), "unrelated").when((2 * F.col("n") > F.col("statements")) & (F.col("kinds") >= 2), "anchored").otherwise("uncertain")
    return rows.select("old_occ", "new_occ", relation.alias("relation"))


def resolve_groups(edges: DataFrame) -> DataFrame:
    """Pairs of old and new groups of duplicates (D20, J6): ``edges`` (old_group, new_group) connect groups with equal
    fingerprints or related members; a component with more than one group on a side is ambiguous."""
    from .graph import connected_components

    named = edges.select(F.concat(F.lit("old:"), "old_group").alias("a"), F.concat(F.lit("new:"), "new_group").alias("b")).distinct()
    parts = connected_components(named)
    old = parts.filter("node LIKE 'old:%'").select("component", F.substring("node", 5, 1 << 20).alias("old_group"))
    new = parts.filter("node LIKE 'new:%'").select("component", F.substring("node", 5, 1 << 20).alias("new_group"))
    sizes = old.groupBy("component").agg(F.count(F.lit(1)).alias("olds")).join(new.groupBy("component").agg(F.count(F.lit(1)).alias("news")), "component")  # edges have both ends
    rows = old.unionByName(new, allowMissingColumns=True).join(sizes, "component")
    return rows.select("component", "old_group", "new_group", F.when((F.col("olds") > 1) | (F.col("news") > 1), "ambiguous").otherwise("paired").alias("resolution"))
