"""Evidence families of whole files in one Arrow pass, and their tables (C1-C24, Q).

A language's extractor is a function from bytes to a row of ``SCHEMA``; ``LANGUAGES`` is the registry, which callers may
extend.  A file that cannot be parsed gives a failed row with a diagnostic; a family that fails voids itself only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import clone_runs, complexity, declarations, detectors, rules
from .parsed import Parsed, Problem

SPAN = "start_line:int,end_line:int"
FAMILIES = {
    "functions": f"array<struct<qualified_name:string,complexity:int,assertion_count:int,{SPAN},sloc:int>>",
    "findings": f"array<struct<rule_id:string,category:string,severity:string,message:string,{SPAN},scope:string,statement:string>>",
    "clones": f"array<struct<{SPAN},statement_count:int,sloc:int,normalization_version:string,tokens:array<string>,owner:string,suite:string,statements:array<struct<{SPAN},digest:string>>>>",
    "symbols": f"array<struct<kind:string,qualified_name:string,{SPAN},ast_fingerprint:string,rename_fingerprint:string>>",
    "imports": "array<struct<line:int,level:int,target:string,name:string,expression:string,execution:string,guards:array<string>,reason:string>>",
    "dispatch": f"array<struct<symbol:string,subject:string,operator:string,values:array<string>,context:string,{SPAN},start_column:int,end_column:int>>",
    "handlers": f"array<struct<symbol:string,caught:string,state:string,reason:string,fallback_kind:string,signature:string,{SPAN}>>",
    "variants": f"array<struct<symbol:string,subject:string,state:string,reason:string,outcome:string,declared:array<string>,missing:array<string>,{SPAN}>>",
    "derived": f"array<struct<symbol:string,state:string,reason:string,derived:string,source:string,operation:string,{SPAN}>>",
    "models": f"array<struct<model:string,state:string,reason:string,guard:string,consumers:array<string>,{SPAN}>>",
}
SCHEMA = (
    "parse_state string, sloc int, sloc_lines array<int>, diagnostic struct<severity:string,code:string,message:string,start_line:int,end_line:int>, members array<string>, "
    + ", ".join(f"{k} {v}" for k, v in FAMILIES.items())
    + ", failed_families array<struct<family:string,message:string>>"
)


def python_file(content: bytes, options: dict) -> dict:
    """All families of one Python file."""
    empty = {k: [] for k in FAMILIES} | {"failed_families": [], "members": []}
    try:
        unit = Parsed(bytes(content))
        lines = unit.sloc_lines
    except Problem as problem:
        diagnostic = {"severity": "error", "code": problem.code, "message": problem.message, "start_line": problem.start_line, "end_line": problem.end_line}
        return empty | {"parse_state": "failed", "sloc": 0, "sloc_lines": [], "diagnostic": diagnostic}
    out = empty | {"parse_state": "parsed", "sloc": len(lines), "sloc_lines": lines, "diagnostic": None}
    chosen = rules.select_rules(options.get("enabled_rules"), options.get("disabled_rules"))

    def with_context() -> list[dict]:
        found = rules.findings(unit, chosen)
        for f in found:
            f["scope"], f["statement"] = declarations.statement_context(unit, f["start_line"], f["end_line"])
        return found

    makers: dict[str, Callable[[], list]] = {
        "functions": lambda: complexity.callables(unit),
        "findings": with_context,
        "clones": lambda: clone_runs.clone_runs(unit, min_statements=options.get("clone_min_statements", 2), min_sloc=options.get("clone_min_sloc", 6)),
        "symbols": lambda: declarations.symbols(unit),
        "imports": lambda: declarations.imports(unit),
        "dispatch": lambda: declarations.state_dispatch(unit),
        "handlers": lambda: detectors.error_fallbacks(unit),
        "variants": lambda: detectors.variants(unit),
        "derived": lambda: detectors.derived_state(unit),
        "models": lambda: detectors.coupled_models(unit),
        "members": lambda: declarations.package_members(unit),
    }
    wanted = options.get("families")
    for family, make in makers.items():
        if wanted is not None and family not in wanted:
            continue
        try:
            out[family] = make()
        except Exception as error:  # one family's failure leaves the others standing
            out["failed_families"].append({"family": family, "message": f"{type(error).__name__}: {error}"})
    return out


#: Language id -> extractor of a file's bytes.
LANGUAGES: dict[str, Callable[[bytes, dict], dict]] = {"python": python_file}
#: File suffix (lower case) -> language id.
SUFFIXES: dict[str, str] = {".py": "python", ".pyi": "python"}


#: Families that a language's extractor may give; the others must stay empty.
CAPABILITIES: dict[str, frozenset[str]] = {"python": frozenset(FAMILIES)}


def register(language: str, maker: Callable[[bytes, dict], dict], capabilities: set[str], suffixes: tuple[str, ...] = ()) -> None:
    """Add a language: its extractor, the families it gives, and the suffixes of its files."""
    if unknown := capabilities - {*FAMILIES}:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    LANGUAGES[language], CAPABILITIES[language] = maker, frozenset(capabilities)
    SUFFIXES.update(dict.fromkeys(suffixes, language))


def held_to_contract(row: dict, capabilities: frozenset[str]) -> dict:
    """An extractor's row, if it gives no family that was not declared, and a reason where it failed."""
    if undeclared := sorted(k for k in FAMILIES if row.get(k) and k not in capabilities):
        raise ValueError(f"undeclared families: {undeclared}")
    if row["parse_state"] == "failed" and not row.get("diagnostic"):
        raise ValueError("a failed file has a diagnostic")
    return {k: [] for k in FAMILIES} | {"sloc": 0, "sloc_lines": [], "diagnostic": None, "members": [], "failed_families": []} | row


def extract(documents: DataFrame, *, content_col: str = "content", language_col: str = "language", **options) -> DataFrame:
    """``documents`` (all columns but the content) with the columns of ``SCHEMA``; options: ``enabled_rules``,
    ``disabled_rules``, ``clone_min_statements``, ``clone_min_sloc``, ``families`` (those wanted; all by default).

    One pass and one Python boundary for all families.  Rows of languages without an extractor come out unsupported.
    """
    rules.select_rules(options.get("enabled_rules"), options.get("disabled_rules"))  # errors belong to the driver
    registry, declared = dict(LANGUAGES), dict(CAPABILITIES)
    kept = [c for c in documents.columns if c != content_col]
    schema = StructType([*documents.select(*kept).schema.fields, *StructType.fromDDL(SCHEMA).fields])
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    columns = documents.select(*kept, content_col).columns
    at_content, at_language = columns.index(content_col), columns.index(language_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                rows = []
                for language, content in zip(batch.column(at_language).to_pylist(), batch.column(at_content), strict=True):
                    maker = registry.get(language)
                    if maker is None:
                        rows.append({k: [] for k in FAMILIES} | {"parse_state": "unsupported", "sloc": 0, "sloc_lines": [], "diagnostic": None, "members": [], "failed_families": []})
                        continue
                    try:
                        rows.append(held_to_contract(maker(content.as_py() or b"", options), declared.get(language, frozenset(FAMILIES))))
                    except Exception as error:
                        rows.append({k: [] for k in FAMILIES} | {"parse_state": "failed", "sloc": 0, "sloc_lines": [], "members": [], "failed_families": [], "diagnostic": {"severity": "error", "code": f"{language}.adapter-failed", "message": f"{type(error).__name__}: {error}", "start_line": None, "end_line": None}})
                made = pa.Table.from_pylist(rows, schema=arrow).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at_content], *made.columns], names=schema.fieldNames())

    return documents.select(*kept, content_col).mapInArrow(run, schema)


def family(evidence: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row per item of a family."""
    return evidence.select(*keys, F.explode(name).alias("item")).select(*keys, "item.*")


def sloc_lines(evidence: DataFrame, keys: list[str]) -> DataFrame:
    return evidence.select(*keys, F.explode("sloc_lines").alias("line"))


def diagnostics(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Parse errors and failed families as diagnostics."""
    parse = evidence.filter("diagnostic IS NOT NULL").select(*keys, "diagnostic.*")
    failed = evidence.select(*keys, F.explode("failed_families").alias("f")).select(
        *keys, F.lit("error").alias("severity"), F.concat(F.lit("analyzer-failed."), "f.family").alias("code"), F.col("f.message").alias("message"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")
    )
    return parse.unionByName(failed)
