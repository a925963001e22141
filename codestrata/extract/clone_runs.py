"""Runs of sibling statements, normalized so that renamed local names don't matter.

Tokens come from the syntax tree: node kinds and fields, names, and the spelling of literals as it stands in the source.
They are comparable within one ``NORMALIZATION_VERSION`` only.
"""

from __future__ import annotations

import ast
import hashlib

from .parsed import COMPREHENSIONS, DEFINITIONS, FUNCTIONS, Parsed

NORMALIZATION_VERSION = "codestrata-runs-1"
_CUTS = (ast.Import, ast.ImportFrom, *DEFINITIONS)
_UNSURE = (ast.Global, ast.Nonlocal, ast.Lambda, *COMPREHENSIONS, ast.NamedExpr, ast.Import, ast.ImportFrom, ast.ExceptHandler, ast.Match, *DEFINITIONS)
_DYNAMIC = {"exec", "eval", "locals", "globals", "vars"}


def local_names(function: ast.AST) -> dict[str, str] | None:
    """Stand-ins for parameters and local names in the order of their first binding; null where binding is uncertain."""
    inside = [n for s in function.body for n in ast.walk(s)]
    if function.type_params or any(isinstance(n, _UNSURE) or (isinstance(n, ast.Name) and n.id in _DYNAMIC) for n in inside):
        return None
    a = function.args
    given = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    names = {x.arg: f"parameter:{i}" for i, x in enumerate(given)}
    stored = sorted((n for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)), key=lambda n: (n.lineno, n.col_offset))
    for n in stored:
        names.setdefault(n.id, f"local:{len(names) - len(given)}")
    return names


def _stand_ins(unit: Parsed) -> dict[ast.AST, str]:
    out = {}
    for function in unit.of(*FUNCTIONS):
        names = local_names(function)
        if names:
            out.update({n: names[n.id] for s in function.body for n in ast.walk(s) if isinstance(n, ast.Name) and n.id in names})
    return out


def tokens_of(unit: Parsed, node: ast.AST, stand_ins: dict[ast.AST, str], skip: set[ast.AST]) -> list[str]:
    """Flat token form of a statement; comments, layout and docstrings leave no trace."""
    out: list[str] = []
    pending: list[object] = [node]
    while pending:
        item = pending.pop()
        if isinstance(item, str):
            out.append(item)
        elif item in skip:
            continue
        elif isinstance(item, ast.Name):
            out += ["begin:Name", stand_ins.get(item, f"name:{item.id}"), "end"]
        elif isinstance(item, (ast.Constant, ast.JoinedStr)):
            out += [f"begin:{type(item).__name__}", "text:" + (ast.get_source_segment(unit.text, item) or ast.dump(item)), "end"]
            if isinstance(item, ast.JoinedStr):
                pending += ["end", *[x for x in reversed(item.values) if isinstance(x, ast.FormattedValue)], "begin:parts"]
        else:
            parts: list[object] = [f"begin:{type(item).__name__}"]
            for field, value in ast.iter_fields(item):
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, (ast.expr_context, ast.Load)):
                        continue
                    if isinstance(x, ast.AST):
                        parts += [f"field:{field}", x]
                    elif x is not None:
                        parts.append(f"{field}:{x}")
            pending += [*reversed([*parts, "end"])]
    return out


def _statement(statement: ast.stmt) -> dict:
    return {"start_line": statement.lineno, "end_line": statement.end_lineno, "digest": hashlib.sha256(ast.dump(statement).encode()).hexdigest()}


def suite_path(unit: Parsed, statement: ast.stmt) -> str:
    """Where a statement's suite hangs in its definition: node kinds and fields from the definition inwards (C14)."""
    parts, child, up = [], statement, unit.parent.get(statement)
    while up is not None:
        field = next((f for f, v in ast.iter_fields(up) if v is child or (isinstance(v, list) and any(x is child for x in v))), "")
        parts.append(f"{type(up).__name__}.{field}")
        if isinstance(up, DEFINITIONS):
            break
        child, up = up, unit.parent.get(up)
    return "/".join(reversed(parts))


def clone_runs(unit: Parsed, *, min_statements: int = 2, min_sloc: int = 6) -> list[dict]:
    """Maximal runs between imports, definitions and docstrings that reach both minima."""
    docstrings, stand_ins = set(unit.docstrings), None
    out = {}
    for suite in unit.suites:
        run: list[ast.stmt] = []
        for statement in [*suite, None]:
            if statement is not None and not isinstance(statement, _CUTS) and statement not in docstrings:
                run.append(statement)
                continue
            if len(run) >= min_statements:
                start, end = run[0].lineno, run[-1].end_lineno
                sloc = unit.sloc_between(start, end)
                if sloc >= min_sloc:
                    stand_ins = _stand_ins(unit) if stand_ins is None else stand_ins
                    tokens = [t for s in run for t in tokens_of(unit, s, stand_ins, docstrings)]
                    out[start, end, tuple(tokens)] = {"start_line": start, "end_line": end, "statement_count": len(run), "sloc": sloc, "normalization_version": NORMALIZATION_VERSION, "tokens": tokens, "owner": ".".join(unit.scope_of(run[0])), "suite": suite_path(unit, run[0]), "statements": [_statement(s) for s in run]}
            run = []
    return [out[k] for k in sorted(out)]
