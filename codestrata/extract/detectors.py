"""Experimental detectors (L1-L4): each candidate is assessed, or unresolved with a reason; none feeds a score."""

from __future__ import annotations

import ast
from collections import Counter

from .parsed import DEFINITIONS, FUNCTIONS, Parsed


class Unsure(Exception):
    """A candidate that cannot be assessed; the text is the reason."""


def _own(nodes: list[ast.AST], *, handlers: bool = True) -> list[ast.AST]:
    """Nodes that run as part of these ones: not the insides of nested definitions and lambdas."""
    out, pending = [], list(reversed(nodes))
    while pending:
        node = pending.pop()
        if isinstance(node, ast.ExceptHandler) and not handlers:
            continue
        out.append(node)
        if not isinstance(node, (*DEFINITIONS, ast.Lambda)):
            pending += reversed(list(ast.iter_child_nodes(node)))
    return out


# --- L1: handlers that turn an error into a default -------------------------------------------------------------------


def default_kind(value: ast.expr | None) -> str | None:
    """Kind of an empty default that a return gives, or null."""
    if value is None:
        return "none"
    if isinstance(value, ast.UnaryOp) and isinstance(value.op, (ast.UAdd, ast.USub)):
        value = value.operand
        return "zero" if isinstance(value, ast.Constant) and type(value.value) in (int, float, complex) and value.value == 0 else None
    if isinstance(value, ast.Constant):
        v = value.value
        if v is None or v is False:
            return "none" if v is None else "false"
        if type(v) in (int, float, complex):
            return "zero" if v == 0 else None
        return {"": "empty-string", b"": "empty-bytes"}.get(v) if isinstance(v, (str, bytes)) else None
    for kind, field, name in ((ast.List, "elts", "empty-list"), (ast.Tuple, "elts", "empty-tuple"), (ast.Dict, "keys", "empty-dict")):
        if isinstance(value, kind) and not getattr(value, field):
            return name
    return None


def _is_literal(value: ast.expr) -> bool:
    try:
        ast.literal_eval(value)
    except (ValueError, TypeError, SyntaxError, RecursionError):
        return False
    return True


def _dotted(value: ast.expr) -> bool:
    while isinstance(value, ast.Attribute):
        value = value.value
    return isinstance(value, ast.Name)


def _handler(unit: Parsed, handler: ast.ExceptHandler) -> dict:
    """Facts of one handler; raises ``Unsure`` for the first check that blocks."""
    protected = unit.parent[handler]
    if isinstance(protected, ast.TryStar):
        raise Unsure("except-star")
    up, inside = unit.parent.get(protected), protected
    while up is not None and not isinstance(up, FUNCTIONS):
        if isinstance(up, (ast.ClassDef, ast.Lambda)):
            raise Unsure("module-or-class-scope")
        if isinstance(up, (ast.Try, ast.TryStar)) and up.finalbody and inside not in up.finalbody:
            raise Unsure("enclosing-finally")
        inside, up = up, unit.parent.get(up)
    if up is None:
        raise Unsure("module-or-class-scope")
    if protected.finalbody:
        raise Unsure("enclosing-finally")
    body = _own(up.body)
    if any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in body):
        raise Unsure("generator")
    kinds = handler.type.elts if isinstance(handler.type, ast.Tuple) else [handler.type] if handler.type else []
    if not all(map(_dotted, kinds)):
        raise Unsure("dynamic-exception")
    for statement in handler.body[:-1]:
        if isinstance(statement, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            raise Unsure("early-exit")
    simple = (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Pass)
    last = handler.body[-1]
    if not all(isinstance(s, simple) for s in handler.body[:-1]) or not isinstance(last, (*simple, ast.Return, ast.Raise)):
        raise Unsure("control-flow")
    caught = ast.unparse(handler.type) if handler.type else "bare except"
    facts = {"caught": caught, "fallback_kind": None, "signature": ast.unparse(ast.Module(protected.body, [])) + "|" + caught}
    if not isinstance(last, ast.Return):
        return facts
    kind = default_kind(last.value)
    if kind is None:
        if _is_literal(last.value):
            return facts
        raise Unsure("indirect-value")
    normal = [n for n in _own(up.body, handlers=False) if isinstance(n, ast.Return) and n.value is not None and default_kind(n.value) is None]
    return facts | {"fallback_kind": kind if normal else None, "signature": facts["signature"] + "|" + kind}


def error_fallbacks(unit: Parsed) -> list[dict]:
    """Every handler: whether it ends in an empty default while the function returns something else elsewhere."""
    out = []
    for node in unit.of(ast.ExceptHandler):
        base = {"symbol": ".".join(unit.scope_of(node)), "caught": None, "reason": None, "fallback_kind": None, "signature": None, "start_line": node.lineno, "end_line": node.end_lineno}
        try:
            out.append(base | {"state": "assessed"} | _handler(unit, node))
        except Unsure as why:
            out.append(base | {"state": "unresolved", "reason": str(why)})
    return sorted(out, key=lambda h: (h["start_line"], h["end_line"]))


# --- L3: matches over closed sets of variants -------------------------------------------------------------------------


def _variant_sets(unit: Parsed) -> dict[str, list[str]]:
    """Variants of the file's own enumerations (``Name.MEMBER``) and literal aliases (their values' source form)."""
    out = {}
    for node in unit.tree.body:
        if isinstance(node, ast.ClassDef) and any(isinstance(b, (ast.Name, ast.Attribute)) and ast.unparse(b).rpartition(".")[2] in ("Enum", "IntEnum", "StrEnum") for b in node.bases):
            names = [t.id for s in node.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name) and not t.id.startswith("_")]
            if names:
                out[node.name] = [f"{node.name}.{n}" for n in names]
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (values := _literal_values(node.value)):
            out[node.targets[0].id] = values
    return out


def _literal_values(node: ast.AST | None) -> list[str]:
    if not (isinstance(node, ast.Subscript) and ast.unparse(node.value).rpartition(".")[2] == "Literal"):
        return []
    items = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
    return [ast.unparse(i) for i in items] if all(isinstance(i, ast.Constant) for i in items) else []


def _covered(pattern: ast.pattern) -> list[str] | None:
    """Variants that a pattern takes; null for all of them."""
    if isinstance(pattern, ast.MatchOr):
        parts = [_covered(p) for p in pattern.patterns]
        return None if None in parts else [v for p in parts for v in p]
    if isinstance(pattern, ast.MatchAs):
        return None if pattern.pattern is None else _covered(pattern.pattern)
    if isinstance(pattern, ast.MatchValue):
        return [ast.unparse(pattern.value)]
    if isinstance(pattern, ast.MatchSingleton):
        return [repr(pattern.value)]
    raise Unsure("unsupported-pattern")


def variants(unit: Parsed) -> list[dict]:
    """Functions whose first statement matches a parameter typed by a closed set: exhaustive, with a fallback, or missing
    some.  Guarded cases cover nothing (E22)."""
    sets, out = _variant_sets(unit), []
    for function in unit.of(*FUNCTIONS):
        body = [s for s in function.body if s not in unit.docstrings]
        if not body or not isinstance(body[0], ast.Match) or not isinstance(body[0].subject, ast.Name):
            continue
        match = body[0]
        typed = {a.arg: a.annotation for a in (*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs)}
        note = typed.get(match.subject.id)
        name = note.value if isinstance(note, ast.Constant) and isinstance(note.value, str) else ast.unparse(note) if note is not None else ""
        declared = sets.get(name) or _literal_values(note)
        base = {"symbol": ".".join([*unit.scope_of(function), function.name]), "subject": match.subject.id, "reason": None, "outcome": None, "declared": declared, "missing": [], "start_line": match.lineno, "end_line": match.end_lineno}
        if not declared:
            out.append(base | {"state": "unresolved", "reason": "open-type"})
            continue
        try:
            taken, fallback = set(), False
            for case in match.cases:
                found = _covered(case.pattern)
                if case.guard is not None:
                    continue
                fallback = fallback or found is None
                taken.update(found or ())
            missing = [v for v in declared if v not in taken]
            out.append(base | {"state": "assessed", "missing": missing, "outcome": "exhaustive" if not missing else "fallback" if fallback else "missing"})
        except Unsure as why:
            out.append(base | {"state": "unresolved", "reason": str(why)})
    return sorted(out, key=lambda v: (v["start_line"], v["end_line"]))


# --- L4: lengths that go stale ----------------------------------------------------------------------------------------


def _constant(node: ast.expr) -> bool:
    """Numbers and other constants, signed or not, and lists and tuples of them."""
    match node:
        case ast.Constant():
            return True
        case ast.List(elts=parts) | ast.Tuple(elts=parts):
            return all(map(_constant, parts))
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=ast.Constant(value=int() | float() | complex())):
            return True
    return False


def _grows(operation: str, args: list[ast.expr]) -> bool:
    """Whether a call of a list's method surely makes it longer (or surely does nothing); others are out of reach."""
    match operation, args:
        case "append", [item] if _constant(item):
            return True
        case "insert", [ast.Constant(value=int()), item] if _constant(item):
            return True
        case "extend", [ast.List(elts=parts) as items] if _constant(items):
            return bool(parts)
    raise Unsure("unsupported-mutation")


class _StraightLine:
    """What is known of a function's local names after each statement: lists made of constants, lengths taken of them, and
    plain values.  Whatever may hide a list behind another name ends the analysis."""

    def __init__(self):
        self.lists: set[str] = set()
        self.plain: set[str] = set()
        self.lengths: dict[str, tuple[str, int]] = {}
        self.stale: dict[str, str] = {}  # length -> the operation that made its list longer
        self.found: list[dict] = []

    def use(self, value: ast.expr, end: int) -> None:
        match value:
            case ast.Name(id=name) if name in self.plain:
                if name in self.stale:
                    source, line = self.lengths[name]
                    self.found.append({"derived": name, "source": source, "operation": self.stale[name], "start_line": line, "end_line": end})
            case ast.Tuple(elts=parts) | ast.List(elts=parts):
                for part in parts:
                    self.use(part, end)
            case _ if not _constant(value):
                raise Unsure("possible-alias" if isinstance(value, ast.Name) else "unsupported-read")

    def bind(self, name: str, length: tuple[str, int] | None = None) -> None:
        self.plain.add(name)
        self.stale.pop(name, None)
        self.lengths.pop(name, None)
        if length:
            self.lengths[name] = length

    def after(self, s: ast.stmt) -> None:
        match s:
            case ast.Pass() | ast.Expr(value=ast.Constant()):
                pass
            case ast.Assign(targets=[ast.Name(id=name)]) if name in self.lists:
                raise Unsure("rebound-list")
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.List() as value) if _constant(value):
                self.bind(name)
                self.plain.discard(name)
                self.lists.add(name)
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call(func=ast.Name(id="len"), args=[ast.Name(id=source)], keywords=[])) if source in self.lists:
                self.bind(name, (source, s.lineno))
            case ast.Assign(value=ast.Call()):
                raise Unsure("unknown-call")
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                self.use(value, s.end_lineno)
                self.bind(name)
            case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=source), attr=operation), args=args, keywords=[])) if source in self.lists:
                if _grows(operation, args):
                    for name, (of, _) in self.lengths.items():
                        if of == source:
                            self.stale.setdefault(name, operation)
            case ast.Expr():
                raise Unsure("unknown-call")
            case _:
                raise Unsure("control-flow")


def derived_state(unit: Parsed) -> list[dict]:
    """A straight line of statements in which the length of a local list of constants is taken, the list grows, and the old
    length is read.  A function that takes a length and does more than that is unresolved, with the reason."""
    out = []
    for function in unit.of(*FUNCTIONS):
        if not any(isinstance(n, ast.Name) and n.id == "len" for n in _own(function.body)):
            continue
        line, reason = _StraightLine(), None if unit.is_builtin("len") else "shadowed-builtin"
        try:
            for s in function.body if reason is None else ():
                if isinstance(s, ast.Return):
                    if s.value is not None:
                        line.use(s.value, s.end_lineno)
                    break
                line.after(s)
        except Unsure as why:
            reason = str(why)
        base = {"symbol": ".".join([*unit.scope_of(function), function.name])}
        if reason:
            out.append(base | {"state": "unresolved", "reason": reason, "derived": None, "source": None, "operation": None, "start_line": function.lineno, "end_line": function.end_lineno})
        else:
            out += [base | {"state": "assessed", "reason": None} | f for n, f in enumerate(line.found) if f not in line.found[:n]]
    return sorted(out, key=lambda d: (d["start_line"], d["end_line"]))


# --- L2: dataclasses whose fields are coupled -------------------------------------------------------------------------


def _flag_or_optional(note: ast.expr) -> str | None:
    if isinstance(note, ast.Name) and note.id == "bool":
        return "flag"
    sides = [note.left, note.right] if isinstance(note, ast.BinOp) and isinstance(note.op, ast.BitOr) else []
    return "optional" if any(isinstance(x, ast.Constant) and x.value is None for x in sides) else None


def _guard_form(test: ast.expr, owner: str, fields: dict[str, str | None]) -> str | None:
    """A test of nothing but the flags and the missing optional fields of ``owner``, with its name put out of it; else null."""
    match test:
        case ast.Attribute(value=ast.Name(id=name), attr=field) if name == owner and fields.get(field) == "flag":
            return f"_.{field}"
        case ast.BoolOp(op=op, values=values):
            parts = [_guard_form(v, owner, fields) for v in values]
            return None if None in parts else "(" + (" and " if isinstance(op, ast.And) else " or ").join(parts) + ")"
        case ast.UnaryOp(op=ast.Not(), operand=operand):
            part = _guard_form(operand, owner, fields)
            return part and f"not {part}"
        case ast.Compare(left=ast.Attribute(value=ast.Name(id=name), attr=field), ops=[ast.Is() | ast.IsNot() as op], comparators=[ast.Constant(value=None)]) if name == owner and fields.get(field) == "optional":
            return f"_.{field} is {'not ' if isinstance(op, ast.IsNot) else ''}None"
    return None


def _opening_guard(unit: Parsed, function: ast.AST) -> ast.If | None:
    """The ``if`` that a function starts with: before it nothing can change what it was given."""
    first = next((s for s in function.body if s not in unit.docstrings), None)
    return first if isinstance(first, ast.If) else None


def _plain_function(function: ast.AST, owner: str) -> bool:
    """Whether a function has no decorator, no inner scope and no outer name of its own, and never binds ``owner`` anew."""
    inner = (*FUNCTIONS, ast.ClassDef, ast.Lambda, ast.Global, ast.Nonlocal)
    nodes = [n for s in function.body for n in ast.walk(s)]
    return not (function.decorator_list or function.type_params or any(isinstance(n, inner) or owner in Parsed.binds(n) for n in nodes))


def _all_arguments(function: ast.AST) -> list[ast.arg]:
    return [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]


def _model_problem(unit: Parsed, model: ast.ClassDef, bound: Counter) -> str | None:
    """Why a dataclass cannot be judged."""
    if model not in unit.tree.body or model.bases or model.keywords or model.type_params:
        return "unsupported-model"
    if bound[model.name] != 1 or bound["bool"] or bound["*"]:
        return "ambiguous-name"
    if any(isinstance(s, FUNCTIONS) and s.name == "__init__" for s in model.body):
        return "custom-construction"
    direct = {a.asname or a.name for s in unit.tree.body if isinstance(s, ast.ImportFrom) and s.module == "dataclasses" and not s.level for a in s.names if a.name == "dataclass"}
    used = model.decorator_list[0] if len(model.decorator_list) == 1 else None
    used = used.func if isinstance(used, ast.Call) else used
    if not isinstance(used, ast.Name) or used.id not in direct or bound[used.id] != 1:
        return "unsupported-decorator"
    return None


def coupled_models(unit: Parsed) -> list[dict]:
    """Plain dataclasses of flags and optional fields whose first check in ``__post_init__`` ties both kinds together, where
    at least two typed functions open with that same check."""
    out, bound = [], Counter(name for node in unit.nodes for name in unit.binds(node))
    for model in unit.of(ast.ClassDef):
        marks = [d.func if isinstance(d, ast.Call) else d for d in model.decorator_list]
        if not any(ast.unparse(d).split(".")[-1] == "dataclass" for d in marks):
            continue
        fields = {s.target.id: _flag_or_optional(s.annotation) for s in model.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)}
        base = {"model": model.name, "reason": None, "guard": None, "consumers": [], "start_line": model.lineno, "end_line": model.end_lineno}
        problem = _model_problem(unit, model, bound) or ("unsupported-field" if not fields or None in fields.values() else None)
        if problem:
            out.append(base | {"state": "unresolved", "reason": problem})
            continue
        checks = [s for s in model.body if isinstance(s, ast.FunctionDef) and s.name == "__post_init__"]
        if len(checks) != 1 or not _all_arguments(checks[0]):
            continue
        owner, first = _all_arguments(checks[0])[0].arg, _opening_guard(unit, checks[0])
        if first is None or len(first.body) != 1 or not isinstance(first.body[0], ast.Raise) or not _plain_function(checks[0], owner):
            continue
        guard = _guard_form(first.test, owner, fields)
        if guard is None or {fields[n.attr] for n in ast.walk(first.test) if isinstance(n, ast.Attribute)} != {"flag", "optional"}:
            continue
        consumers = []
        for function in unit.tree.body:
            opening = _opening_guard(unit, function) if isinstance(function, FUNCTIONS) and bound[function.name] == 1 else None
            if opening is None or any(a.arg == model.name for a in _all_arguments(function)):
                continue
            typed = [a.arg for a in _all_arguments(function) if a.annotation is not None and ast.unparse(a.annotation).strip("'\"") == model.name]
            if any(_plain_function(function, arg) and _guard_form(opening.test, arg, fields) == guard for arg in typed):
                consumers.append(function.name)
        out.append(base | {"state": "assessed", "guard": guard if len(consumers) >= 2 else None, "consumers": consumers})
    return sorted(out, key=lambda m: m["start_line"])
