"""Callables and their cyclomatic complexity.

Complexity is one plus: 1 for each ``if``, ternary, loop, ``except`` clause, ``assert``, comprehension clause and
comprehension filter; 1 for each ``else`` of a loop or of a ``try``; n - 1 for a chain of n ``and``/``or`` operands; and, for a
``match``, its cases less one if some case takes everything.  A lambda adds nothing itself, but what its body decides
counts.  What an assertion tests is not looked into.  Nested functions and classes are counted for themselves only.
"""

from __future__ import annotations

import ast

from .parsed import DEFINITIONS, FUNCTIONS, Parsed

COMPLEXITY_VERSION = "decisions-2"
_ONE = (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_TRIES = (ast.Try, ast.TryStar)


def _takes_everything(case: ast.match_case) -> bool:
    return isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None


def _decisions(node: ast.AST) -> int:
    if isinstance(node, _ONE):
        return 1
    if isinstance(node, _LOOPS):
        return 2 if node.orelse else 1
    if isinstance(node, _TRIES):
        return 1 if node.orelse else 0
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, ast.Match):
        return len(node.cases) - any(map(_takes_everything, node.cases))
    return 0


def complexity(function: ast.AST) -> tuple[int, int]:
    """Complexity of a callable, and how much of it is assertions."""
    total, asserts, pending = 1, 0, list(function.body)
    while pending:
        node = pending.pop()
        if isinstance(node, DEFINITIONS):
            continue
        total += _decisions(node)
        if isinstance(node, ast.Assert):
            asserts += 1
        else:
            pending += ast.iter_child_nodes(node)
    return total, asserts


def callables(unit: Parsed) -> list[dict]:
    out = []
    for node in unit.of(*FUNCTIONS):
        total, asserts = complexity(node)
        out.append(
            {"qualified_name": ".".join([*unit.scope_of(node), node.name]), "complexity": total, "assertion_count": asserts, "start_line": node.lineno, "end_line": node.end_lineno,
             "sloc": unit.sloc_between(node.lineno, node.end_lineno)}
        )
    return sorted(out, key=lambda f: (f["start_line"], f["end_line"], f["qualified_name"]))
