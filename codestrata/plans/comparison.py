"""Two source states: pairs of files, line deltas, and changes of metrics, findings, duplicates, errors and declarations."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linediff import with_line_deltas
from ..operators import budgets, clones, continuity, coverage, matching
from .snapshot import Snapshot

POPULATION = ["language", "cohort"]
STATES = ["introduced", "removed", "persisted", "changed", "unresolved"]


class Comparison:
    """Tables of a change.  ``hints``: renames that the version control knows (baseline_path, current_path)."""

    def __init__(self, before: Snapshot, after: Snapshot, hints: DataFrame | None = None):
        if before.provenance != after.provenance:
            differing = sorted(k for k in before.provenance if before.provenance[k] != after.provenance.get(k))
            raise ValueError(f"both sides must be analyzed in the same way; these differ: {differing}")
        self.before, self.after, self.hints = before, after, hints

    def _sources(self, side: Snapshot) -> DataFrame:
        return side.files.select("path", *POPULATION, F.col("source_sha256").alias("content_hash"), "parse_state")

    @cached_property
    def pairs(self) -> DataFrame:
        return matching.match_files(self._sources(self.before), self._sources(self.after), self.hints).checkpoint()

    @cached_property
    def line_deltas(self) -> DataFrame:
        """Each pair with its aligned, added and deleted code-bearing lines, and why they are unavailable."""

        def side(s: Snapshot, path: str, content: str, lines: str, state: str) -> DataFrame:
            rows = s.documents.join(s.evidence.select("path", *POPULATION, "sloc_lines", "parse_state"), ["path", *POPULATION])
            return rows.select(F.col("path").alias(path), *POPULATION, F.col("content").alias(content), F.col("sloc_lines").alias(lines), F.col("parse_state").alias(state))

        rows = self.pairs.join(side(self.before, "baseline_path", "before", "old_lines", "_old"), ["baseline_path", *POPULATION], "left")
        rows = rows.join(side(self.after, "current_path", "after", "new_lines", "_new"), ["current_path", *POPULATION], "left")
        out = with_line_deltas(rows).drop("before", "after")
        reason = F.when((F.col("_old") == "failed") | (F.col("_new") == "failed"), "parse-failed").when(F.col("kind") == "unresolved", "unreadable")
        return out.withColumn("reason", reason).drop("_old", "_new").checkpoint()

    def loc(self) -> DataFrame:
        """Added, deleted and net lines by population."""
        d = self.line_deltas
        count = lambda c: F.coalesce(F.size(c), F.lit(0))
        rows = d.select(*POPULATION, count("old_lines").alias("baseline_sloc"), count("new_lines").alias("current_sloc"), count("added").alias("added"), count("deleted").alias("deleted"), "reason")
        return matching.loc_totals(rows, POPULATION)

    def metric_deltas(self) -> DataFrame:
        keep = [*POPULATION, "metric_id", "state", "value", "unit"]
        return matching.metric_deltas(self.before.metrics().select(*keep), self.after.metrics().select(*keep), POPULATION)

    @cached_property
    def line_map(self) -> DataFrame:
        return self.line_deltas.select(F.col("baseline_path").alias("old_path"), F.col("current_path").alias("new_path"), F.explode("aligned").alias("l")).select("old_path", "new_path", F.col("l.old").alias("old_line"), F.col("l.new").alias("new_line"))

    def _file_pairs(self, family: str) -> DataFrame:
        """Pairs of files with a key, ``pair``, and whether evidence of a family can be compared: ``bad`` where a side could not
        be read, parsed or analyzed, or where a file stands alone and the other side leaves files of its language out."""
        key = F.concat_ws("|", *POPULATION, F.coalesce("baseline_path", F.lit("")), F.coalesce("current_path", F.lit("")))
        pairs = self.line_deltas.select(*POPULATION, "baseline_path", "current_path", key.alias("pair"), F.col("reason").isNotNull().alias("bad"))
        for snapshot, other, path, other_path in ((self.before, self.after, "baseline_path", "current_path"), (self.after, self.before, "current_path", "baseline_path")):
            failed = snapshot.failed(family).select(F.col("path").alias(path), F.lit(True).alias("_f"))
            hidden = other.inventory.filter("state IN ('excluded', 'failed') AND language IS NOT NULL").select("language", F.lit(True).alias("_h")).distinct()
            pairs = pairs.join(failed, path, "left").join(hidden, "language", "left")
            alone = F.col(path).isNotNull() & F.col(other_path).isNull() & F.coalesce("_h", F.lit(False))
            pairs = pairs.withColumn("bad", F.col("bad") | F.coalesce("_f", F.lit(False)) | alone).drop("_f", "_h")
        return pairs

    def _sided(self, family: str, key: list[str], rows: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """A family's rows of both sides with ``occ`` and the key of their pair of files, and those of files whose
        counterpart could not be assessed."""
        pairs = self._file_pairs(family).checkpoint()
        out = []
        for k, (snapshot, path) in enumerate(((self.before, "baseline_path"), (self.after, "current_path"))):
            own = rows[k] if rows else snapshot.family(family)
            own = own.withColumn("occ", F.sha2(F.to_json(F.struct("path", *POPULATION, "start_line", "end_line", *key)).cast("binary"), 256))
            out.append(own.join(pairs.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), *POPULATION, "pair", "bad"), ["path", *POPULATION]))
        return out[0].drop("bad"), out[1].drop("bad"), out[0].filter("bad").select("occ"), out[1].filter("bad").select("occ")

    def finding_changes(self) -> DataFrame:
        old, new, bad_old, bad_new = self._sided("findings", ["rule_id"])
        return continuity.pattern_changes(old, new, line_map=self.line_map, unusable_old=bad_old, unusable_new=bad_new)

    def error_changes(self) -> DataFrame:
        old, new, bad_old, bad_new = self._sided("handlers", ["symbol"])
        found = "state = 'assessed' AND fallback_kind IS NOT NULL"
        return continuity.error_changes(old.filter(found), new.filter(found), old, new, unusable_old=bad_old, unusable_new=bad_new, line_map=self.line_map)

    def dispatch_changes(self) -> DataFrame:
        old, new, bad_old, bad_new = self._sided("dispatch", ["symbol", "subject", "operator"])
        return continuity.dispatch_changes(old, new, line_map=self.line_map, unusable_old=bad_old, unusable_new=bad_new)

    def symbol_changes(self) -> DataFrame:
        """Declarations, with old paths of paired files taken for the new ones."""
        paths = self.pairs.filter("baseline_path IS NOT NULL AND current_path IS NOT NULL").select(*POPULATION, F.col("baseline_path").alias("path"), F.col("current_path").alias("_to"))

        def rows(s: Snapshot) -> DataFrame:
            r = s.family("symbols").withColumn("occ", F.sha2(F.concat_ws("|", "path", *POPULATION, "qualified_name", F.col("start_line").cast("string")).cast("binary"), 256))
            return r.select("occ", *POPULATION, "path", F.col("path").alias("place"), "kind", F.col("qualified_name").alias("name"), F.col("ast_fingerprint").alias("ast"), F.col("rename_fingerprint").alias("rename"))

        old = rows(self.before).join(paths, ["path", *POPULATION], "left").withColumn("path", F.coalesce("_to", "path")).drop("_to")
        bad = self.line_deltas.filter("reason IS NOT NULL").select(*POPULATION, F.explode(F.array_compact(F.array("baseline_path", "current_path"))).alias("path"))
        lacking = [s.inventory.filter("state = 'failed'").select(*POPULATION).union(s.files.filter("parse_state = 'failed'").select(*POPULATION)).distinct() for s in (self.before, self.after)]
        return continuity.symbol_changes(old, rows(self.after), unavailable_paths=bad, incomplete_old=lacking[0], incomplete_new=lacking[1])

    @cached_property
    def clone_populations(self) -> tuple[DataFrame, DataFrame]:
        """Runs of both sides that have the fingerprint of a duplicate group of either: ``occ, population`` (a key of language,
        cohort, normalization and fingerprint) and what ``Snapshot.candidates`` has."""
        keys = [*POPULATION, "normalization_version", "fingerprint"]
        groups = self.before.clone_members.select(*keys).union(self.after.clone_members.select(*keys)).distinct()
        out = []
        for s in (self.before, self.after):
            rows = s.candidates.join(groups, keys, "left_semi").withColumn("population", F.sha2(F.concat_ws("|", *keys).cast("binary"), 256))
            out.append(rows.withColumn("occ", F.sha2(F.concat_ws("|", "population", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string")).cast("binary"), 256)).checkpoint())
        return out[0], out[1]

    def member_relations(self) -> DataFrame:
        """Old members of duplicates against new ones of other fingerprints in the mapped file (D19): ``old_population, old_occ,
        new_population, new_occ, relation``.

        Members in the same suite of the same definition are compared where aligned lines lead from the one into the other, or
        where the old one has no aligned line and the new one lies between the lines aligned around it.  Statements are anchors
        where both ends are aligned and they are equal.
        """
        (old, new), lines = self.clone_populations, self.line_deltas.filter("baseline_path IS NOT NULL AND current_path IS NOT NULL")
        shared = [*POPULATION, "normalization_version", "owner", "suite"]
        fields = ["occ", "population", "path", "start_line", "end_line", "statement_count"]
        a, b = (rows.select(*shared, *[F.col(c).alias(f"{side}_{c}") for c in fields]) for rows, side in ((old, "old"), (new, "new")))
        pairs = a.join(lines.select(*POPULATION, F.col("baseline_path").alias("old_path"), F.col("current_path").alias("new_path"), "aligned"), [*POPULATION, "old_path"])
        pairs = pairs.join(b, [*shared, "new_path"]).filter("old_population <> new_population")
        inside = "filter(aligned, x -> x.old BETWEEN old_start_line AND old_end_line)"
        reached = f"exists({inside}, x -> x.new BETWEEN new_start_line AND new_end_line)"
        between = "aggregate(aligned, 0, (m, x) -> if(x.old < old_start_line, greatest(m, x.new), m)) < new_start_line AND new_end_line < aggregate(aligned, 2147483647, (m, x) -> if(x.old > old_end_line, least(m, x.new), m))"
        pairs = pairs.filter(f"if(size({inside}) > 0, {reached}, {between})")
        pairs = pairs.select("old_population", "old_occ", "new_population", "new_occ", F.lit(True).alias("same_owner"), F.greatest("old_statement_count", "new_statement_count").alias("statements")).distinct().checkpoint()

        def parts(rows: DataFrame, side: str) -> DataFrame:
            of = rows.select(F.col("occ").alias(f"{side}_occ"), F.col("path").alias(f"{side}_path"), F.explode("statements").alias("x"))
            return of.select(f"{side}_occ", f"{side}_path", F.col("x.start_line").alias(f"{side}_start"), F.col("x.end_line").alias(f"{side}_end"), F.col("x.digest").alias("fingerprint"))

        first = self.line_map.withColumnsRenamed({"old_line": "old_start", "new_line": "new_start"})
        last = self.line_map.withColumnsRenamed({"old_line": "old_end", "new_line": "new_end"})
        moved = pairs.select("old_occ", "new_occ").join(parts(old, "old"), "old_occ").join(first, ["old_path", "old_start"]).join(last, ["old_path", "new_path", "old_end"])
        anchors = moved.join(parts(new, "new"), ["new_occ", "new_path", "new_start", "new_end", "fingerprint"]).select("old_occ", "new_occ", "fingerprint", "old_start").distinct()
        found = continuity.anchored_relation(pairs, anchors)
        # Overlapping members of one suite without an anchor are not told apart: their relation is uncertain.
        found = found.withColumn("relation", F.when(F.col("relation") == "unrelated", "uncertain").otherwise(F.col("relation")))
        return found.join(pairs.select("old_population", "old_occ", "new_population", "new_occ"), ["old_occ", "new_occ"])

    def group_resolution(self, relations: DataFrame | None = None) -> DataFrame:
        """Which old and new populations belong together (D20, J6): equal ones, and those with members that are not unrelated; a
        component with several on a side is ambiguous.  ``old_group`` and ``new_group`` are keys of populations."""
        old, new = (rows.select("population").distinct() for rows in self.clone_populations)
        equal = old.join(new, "population").select(F.col("population").alias("old_group"), F.col("population").alias("new_group"))
        related = (self.member_relations() if relations is None else relations).select(F.col("old_population").alias("old_group"), F.col("new_population").alias("new_group"))
        return continuity.resolve_groups(equal.union(related).distinct())

    @cached_property
    def clone_member_changes(self) -> DataFrame:
        """``component, state, old_occ, new_occ``: members of groups, old and new ones that belong together taken as one.

        Of equal fingerprints, members persist that are single in a pair of files or whose ends are aligned; of different ones,
        those are changed that are anchored to one another only.  Members whose counterpart could not be assessed, and those
        left on both sides, are unresolved, and so are all members of an ambiguous component, each population by itself.
        """
        relations = self.member_relations().checkpoint()
        resolved = self.group_resolution(relations).checkpoint()
        sides = []
        for rows, side in zip(self.clone_populations, ("old", "new"), strict=True):
            place = resolved.filter(f"{side}_group IS NOT NULL").select(F.col(f"{side}_group").alias("population"), F.col("component").alias("_c"), (F.col("resolution") == "ambiguous").alias("ambiguous"))
            rows = rows.join(place, "population", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
            sides.append(rows.withColumn("component", F.when(F.col("ambiguous") | F.col("_c").isNull(), F.col("population")).otherwise(F.col("_c"))).drop("_c").checkpoint())
        whole = F.concat(F.lit("ambiguous:"), "component").alias("component")
        out = [rows.filter("ambiguous").select(whole, F.lit("unresolved").alias("state"), *[F.col("occ").alias(c) if c == own else F.lit(None).cast("string").alias(c) for c in ("old_occ", "new_occ")]) for rows, own in zip(sides, ("old_occ", "new_occ"), strict=True)]
        old, new = (rows.filter("NOT ambiguous") for rows in sides)
        files = self.line_deltas.filter("baseline_path IS NOT NULL AND current_path IS NOT NULL").select(F.col("baseline_path").alias("old_path"), F.col("current_path").alias("new_path"))
        equal = continuity.match_members(old, new, files, self.line_map, ["component", "population"]).withColumn("state", F.lit("persisted"))
        anchored = relations.filter("relation = 'anchored'").join(old.select(F.col("occ").alias("old_occ"), "component"), "old_occ").join(new.select(F.col("occ").alias("new_occ"), "component"), ["new_occ", "component"])
        edited = continuity.mutual(anchored.select("component", "old_occ", "new_occ"), ["component"]).select("old_occ", "new_occ", F.lit("changed").alias("state"))
        pairs = equal.unionByName(edited).checkpoint()
        rest_old, rest_new = continuity.residue(old, pairs, "old_occ"), continuity.residue(new, pairs, "new_occ")
        bad = self._file_pairs("clones").filter("bad").checkpoint()
        unusable = [rows.join(bad.select(F.col(path).alias("path"), *POPULATION).filter("path IS NOT NULL"), ["path", *POPULATION], "left_semi") for rows, path in ((rest_old, "baseline_path"), (rest_new, "current_path"))]
        rest = continuity.cascade(rest_old.select("occ", "component"), rest_new.select("occ", "component"), [], ["component"], unusable_old=unusable[0], unusable_new=unusable[1])
        found = pairs.select("state", "old_occ", "new_occ").unionByName(rest.select("state", "old_occ", "new_occ"))
        names = old.select("occ", "component").union(new.select("occ", "component")).distinct()
        found = found.withColumn("occ", F.coalesce("old_occ", "new_occ")).join(names, "occ").select("component", "state", "old_occ", "new_occ")
        return found.unionByName(out[0]).unionByName(out[1]).checkpoint()

    def clone_changes(self) -> DataFrame:
        """State of each group of duplicates (E18): ``component, before, after, modified, added, removed, unresolved, state``, by
        the states of its members."""
        count = lambda c: F.count(F.when(c, 1))
        of = lambda s: count(F.col("state") == s)
        rows = self.clone_member_changes.groupBy("component").agg(
            count(F.col("old_occ").isNotNull()).alias("before"), count(F.col("new_occ").isNotNull()).alias("after"),
            of("changed").alias("modified"), of("introduced").alias("added"), of("removed").alias("removed"), of("unresolved").alias("unresolved"),
        )
        return rows.withColumn("state", clones.group_state())

    def review(self) -> dict[str, DataFrame]:
        """Counts of all change families by state, zeros included."""
        families = {"findings": self.finding_changes(), "errors": self.error_changes(), "dispatch": self.dispatch_changes(), "clones": self.clone_changes()}
        more = {"clones": ["expanded", "contracted"]}
        return {name: coverage.state_counts(rows, [*STATES, *more.get(name, [])]) for name, rows in families.items()}

    def blockers(self) -> DataFrame:
        """Why a budget's metric stays incomplete, each reason once (E20): ``metric, detail`` (JSON).  Of every metric: sources
        that could not be read, and errors of either side; of one: changes that stay unresolved, files in which its analysis
        failed, and for errors the handlers that could not be assessed."""
        metrics = {"findings": ("findings", self.finding_changes()), "errors": ("handlers", self.error_changes()), "clones": ("clones", self.clone_member_changes)}
        sources, every = [], F.explode(F.array(*map(F.lit, metrics))).alias("metric")
        for side, s in (("baseline", self.before), ("current", self.after)):
            place = F.lit(side).alias("side")
            left_out = s.inventory.filter("state = 'failed'").select(every, F.lit("analysis-limitation").alias("code"), place, "path", *POPULATION, "reason")
            errors = s.diagnostics.filter("severity = 'error'").select(every, "code", place, "path", "message", "start_line", "end_line")
            sources += [left_out, errors]
            for metric, (family, _) in metrics.items():
                sources.append(s.failed(family).select(F.lit(metric).alias("metric"), F.lit("analysis-failed").alias("code"), place, "path", "reason"))
            unsure = s.family("handlers").filter("state = 'unresolved'")
            sources.append(unsure.select(F.lit("errors").alias("metric"), F.lit("unsupported-handler").alias("code"), place, "path", F.col("reason").alias("message"), "start_line", "end_line"))
        for metric, (_, changes) in metrics.items():
            sources.append(changes.filter("state = 'unresolved'").select(F.lit(metric).alias("metric"), F.lit("unresolved-change").alias("code"), "old_occ", "new_occ"))
        return budgets.merge_blockers(*sources)

    def budget(self, limits: DataFrame) -> DataFrame:
        """Introduced findings, errors and members of duplicates against limits; a metric with a blocker is incomplete."""
        rows = {"findings": self.finding_changes(), "errors": self.error_changes(), "clones": self.clone_member_changes}
        evidence = reduce(DataFrame.unionByName, [changes.filter("state = 'introduced'").select(F.lit(name).alias("metric")) for name, changes in rows.items()])
        return budgets.budget_checks(limits, evidence, self.blockers())
