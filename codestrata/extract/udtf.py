"""Extractors as table functions for SQL (Q): ``SELECT * FROM py_functions(content)`` and so on."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .clone_runs import clone_runs
from .complexity import callables
from .parsed import Parsed, Problem
from .rules import findings, select_rules

_KINDS = {
    "sloc_lines": ("line int", lambda u: [(n,) for n in u.sloc_lines]),
    "py_functions": ("qualified_name string, complexity int, assertion_count int, start_line int, end_line int, sloc int", lambda u: [tuple(f.values()) for f in callables(u)]),
    "py_findings": ("rule_id string, category string, severity string, message string, start_line int, end_line int", lambda u: [tuple(f.values()) for f in findings(u, select_rules())]),
    "clone_runs": ("start_line int, end_line int, statement_count int, sloc int, normalization_version string, tokens array<string>", lambda u: [tuple(r.values())[:6] for r in clone_runs(u)]),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session.  A file that cannot be parsed gives no rows; ``extract`` tells why."""
    for name, (schema, rows) in _KINDS.items():

        class Extractor:
            make = staticmethod(rows)

            def eval(self, content: bytes) -> Iterator[tuple]:
                try:
                    unit = Parsed(bytes(content or b""))
                except Problem:
                    return
                yield from self.make(unit)

        spark.udtf.register(name, udtf(Extractor, returnType=schema))
