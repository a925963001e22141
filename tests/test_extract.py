"""Extractors on literal sources."""

import random

import pytest

from codestrata.extract import clone_runs, complexity, declarations, detectors, rules
from codestrata.extract.parsed import Parsed, Problem

#: Pieces of a module, and which of their lines bear code.
BLOCKS = [
    ("total = 3", "x"),
    ("", "."),
    ("   # an aside", "."),
    ("table = {\n    # rows\n    'k': [\n\n        7,\n    ],\n}", "x.x.xxx"),
    ("note = '''spans\n\n  # kept\n'''", "x.xx"),
    ("note = f'''{total}\n;\n# kept\n{total}'''", "xxxx"),
    ("for k in range(3):\n    'stray string'\n    pass", "xxx"),
    ("def plant(seed):\n    'Docs of one line.'\n    return seed", "x.x"),
    ("async def water():\n    (\n     'Docs '\n     'in brackets'\n    )", "x...."),
    ("class Bed:\n\t'''Docs\n\n\tgo on.\n\t'''; depth = 1\n\tdef dig(self):\n\t\t\"\"\n\t\tself.depth += 1", "x...xx.x"),
    ("@plant\ndef prune():\n    b'bytes are no docs'", "xxx"),
    ("def ü(): 'Docs'; return 'é'", "x"),
]


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("seed", range(6))
def test_lines_with_code_in_modules_put_together_at_random(seed, ends):
    rng = random.Random(seed)
    for _ in range(8):
        blocks = [("total = 0", "x"), *(rng.choice(BLOCKS) for _ in range(rng.randrange(7)))]
        if rng.random() < 0.5:
            blocks.insert(0, ("'''What this\nis for.'''", ".."))
        marks = "".join(m for _, m in blocks)
        source = "\n".join(text for text, _ in blocks).replace("\n", ends) + rng.choice(["", ends])
        unit = Parsed(source.encode())
        assert unit.sloc_lines == [n for n, m in enumerate(marks, 1) if m == "x"]
        assert unit.sloc_between(2, 5) == marks[1:5].count("x")
    assert Parsed(b"").sloc_lines == []


def found_by(rule, source):
    return [(f["start_line"], f["end_line"]) for f in rules.findings(Parsed(source.encode()), rules.select_rules([f"py.{rule}"]))]


def inside(*lines):
    """Lines as the body of a function of one parameter."""
    return "def tend(row):\n" + "".join(f"    {line}\n" for line in lines)


def test_rules_on_single_expressions():
    for yes, no, rule in [
        ("ripe = True if colour == 'red' else False", "ripe = 'yes' if colour == 'red' else False", "boolean-conditional"),
        ("raw = False if colour == 'red' else True", "raw = False if colour == 'red' else None", "negated-boolean-conditional"),
        ("label = f'plain words'", "label = f'{row} words'", "literal-fstring"),
        ("beds = [b for b in [4, 5, 6]]", "beds = [b + 1 for b in [4, 5, 6]]", "literal-identity-comprehension"),
        ("pots = tuple((8, 9))", "pots = tuple(shelf)", "redundant-literal-container"),
        ("depth = {'clay': 3}.get('clay', None)", "depth = {'clay': 3}.get('clay', 0)", "redundant-dict-get-default"),
    ]:
        assert found_by(rule, f"\n{yes}\n") == [(2, 2)], rule
        assert found_by(rule, f"\n{no}\n") == [], rule
    assert found_by("redundant-literal-container", "from shed import *\npots = set({1})\n") == []


def test_rules_on_branches():
    for word, context in (("return", inside), ("raise", inside), ("break", None), ("continue", None)):
        leave = {"return": "return row", "raise": "raise KeyError(row)"}.get(word, word)
        lines = ["if row:", f"    {leave}", "else:", "    grow()"]
        source = context(*lines) if context else "while sun:\n" + "".join(f"    {x}\n" for x in lines)
        assert found_by(f"redundant-else-after-{word}", source) == [(4, 4)], word
        assert found_by(f"redundant-else-after-{word}", source.replace(leave, "wait()")) == [], word
        others = {"return", "raise", "break", "continue"} - {word}
        assert not any(found_by(f"redundant-else-after-{x}", source) for x in others)
    assert found_by("merge-nested-if", inside("if row:", "    if sun:", "        grow()")) == [(3, 3)]
    assert found_by("merge-nested-if", inside("if row:", "    if sun:", "        grow()", "else:", "    wait()")) == []
    assert found_by("redundant-except-reraise", inside("try:", "    grow()", "except:", "    raise")) == [(4, 5)]
    assert found_by("redundant-except-reraise", inside("try:", "    grow()", "except:", "    log()", "    raise")) == []
    assert found_by("empty-finally", inside("try:", "    grow()", "finally:", "    pass")) == [(4, 5)]
    assert found_by("empty-finally", inside("try:", "    grow()", "finally:", "    rake()")) == []


def test_rules_on_none():
    assert found_by("redundant-none-fallback", inside("return row if row is not None else None")) == [(2, 2)]
    assert found_by("redundant-none-fallback", "row = 1\nother = row if row is not None else None\n") == []
    assert found_by("redundant-literal-none-guard", inside("pot = 'clay'", "if pot is None:", "    raise KeyError")) == [(3, 3)]
    assert found_by("redundant-literal-none-guard", inside("pot = row", "if pot is None:", "    raise KeyError")) == []


def test_rules_on_classes():
    assert found_by("redundant-pass", "class Bed:\n    rows = 4\n    pass\n") == [(3, 3)]
    assert found_by("redundant-pass", "class Bed:\n    pass\n") == []
    assert found_by("explicit-object-base", "\nclass Bed(object): rows = 4\n") == [(2, 2)]
    assert found_by("explicit-object-base", "object = Soil\nclass Bed(object): rows = 4\n") == []
    assert found_by("explicit-default-metaclass", "\nclass Bed(metaclass=type): rows = 4\n") == [(2, 2)]
    assert found_by("explicit-default-metaclass", "class Bed(metaclass=Soil): rows = 4\n") == []


def wrapper(*, name="_pass_on", signature="a, b", arguments="a, b", use="return _pass_on(row, 2)", more=()):
    return inside(f"def {name}({signature}):", f"    return dig({arguments})", use.replace("_pass_on", name), *more)


def test_forwarding_wrappers():
    assert found_by("trivial-wrapper", wrapper()) == [(2, 3)]
    assert found_by("trivial-wrapper", wrapper(signature="", arguments="", use="spot = _pass_on()")) == [(2, 3)]
    for kept in (
        wrapper(name="pass_on"),
        wrapper(arguments="b, a"),
        wrapper(arguments="a, b=b"),
        wrapper(signature="a, b=1"),
        wrapper(signature="a, *b"),
        wrapper(signature="a: int, b"),
        wrapper(more=("_pass_on",)),
        wrapper(use="again = [_pass_on(r, 2) for r in row]"),
        wrapper(more=("eval(row)",)),
        wrapper().replace("dig(", "_pass_on("),
        wrapper().replace("def _pass_on", "@memo\n    def _pass_on"),
        "def _pass_on(a):\n    return dig(a)\n_pass_on(1)\n",
    ):
        assert found_by("trivial-wrapper", kept) == [], kept


def test_bindings_that_are_only_returned():
    assert found_by("single-use-return-binding", inside("crop = row.pick()", "return crop")) == [(2, 2)]
    for kept in (
        ("crop = row.pick()", "crop += 1", "return crop"),
        ("crop = row.pick()", "return crops"),
        ("crop = spare = row.pick()", "return crop"),
        ("crop, = row.pick()", "return crop"),
        ("crop = yield row", "return crop"),
        ("global crop", "crop = row.pick()", "return crop"),
        ("def later(): return crop", "crop = row.pick()", "return crop"),
        ("crop = row.pick()  # type: Crop", "return crop"),
        ("if row:", "    crop = 0", "crop = row.pick()", "return crop"),
        ("locals()", "crop = row.pick()", "return crop"),
    ):
        assert found_by("single-use-return-binding", inside(*kept)) == [], kept


def test_catalog_has_twenty_rules_and_rejects_unknown_ones():
    assert len(rules.catalog()) == 20
    assert sum(r["enabled"] for r in rules.catalog(disabled=["py.empty-finally"])) == 19
    with pytest.raises(ValueError, match="unknown"):
        rules.select_rules(["py.nope"])
    with pytest.raises(ValueError, match="both|and"):
        rules.select_rules(["py.empty-finally"], ["py.empty-finally"])


def test_callables_and_complexity():
    decisions = [
        ("x = 1", 0), ("if row: pass", 1), ("if row: pass\nelif sun: pass\nelse: pass", 2), ("x = 1 if row else 2", 1), ("while row: pass", 1), ("for r in row: pass\nelse: pass", 2),
        ("while row: pass\nelse: pass", 2), ("try: pass\nexcept E: pass\nexcept F: pass", 2), ("try: pass\nexcept E: pass\nelse: pass\nfinally: pass", 2), ("try: pass\nexcept* E: pass", 1),
        ("x = row or sun and rain or x", 3), ("x = [r for r in row if r if sun]", 3), ("x = {r: s for r in row for s in r}", 2), ("with row: pass", 0), ("f = lambda a: a if a else sun", 1), ("f = lambda: 0", 0),
        ("match row:\n    case 1: pass\n    case [2]: pass", 2), ("match row:\n    case 1: pass\n    case _: pass", 1), ("match row:\n    case _: pass", 0), ("def own():\n    if sun: pass", 0), ("class Own:\n    x = 1 if row else 2", 0),
    ]
    for source, n in decisions:
        got = complexity.callables(Parsed(inside(*source.split("\n")).encode()))
        assert (got[0]["qualified_name"], got[0]["complexity"], got[0]["assertion_count"]) == ("tend", 1 + n, 0), source
    source = inside(*(x for text, _ in decisions for x in text.split("\n")), "assert row or sun, 'if it is'", "assert sun")
    found = complexity.callables(Parsed(source.encode()))
    assert (found[0]["complexity"], found[0]["assertion_count"]) == (1 + sum(n for _, n in decisions) + 2, 2)
    assert [(f["qualified_name"], f["complexity"], f["sloc"]) for f in found[1:]] == [("tend.own", 2, 2)]


def runs(source, statements=2, sloc=2):
    return clone_runs.clone_runs(Parsed(source.encode()), min_statements=statements, min_sloc=sloc)


def test_runs_end_at_imports_definitions_and_docstrings():
    pair = "dig()\nrake()\n"
    for cut in ("import shed\n", "from shed import hoe\n", "def tend(): ...\n", "class Bed: ...\n"):
        assert [(r["start_line"], r["end_line"]) for r in runs(pair + cut + pair)] == [(1, 2), (4, 5)], cut
    assert [(r["start_line"], r["statement_count"]) for r in runs(pair * 3)] == [(1, 6)]
    nested = [(r["start_line"], r["end_line"], r["statement_count"]) for r in runs("while sun:\n    dig()\n    rake()\nrest()\n")]
    assert nested == [(1, 4, 2), (2, 3, 2)]
    assert [(r["start_line"], r["owner"]) for r in runs("class Bed:\n    'Docs'\n    rows = 2\n    pots = 3\n")] == [(3, "Bed")]
    assert runs("dig(); rake()\n") == [] and runs("dig(); rake()\n", sloc=1) != [] and runs("dig()\n") == []


def same_tokens(one, two):
    return runs(one)[0]["tokens"] == runs(two)[0]["tokens"]


def test_local_names_and_layout_do_not_matter_to_runs():
    body = "def {f}({p}, *{q}):\n    {x} = {p}[0]\n    for {y} in {q}:\n        {x} += {y}\n    return {x}\n"
    one, two = body.format(f="weigh", p="bed", q="pots", x="load", y="pot"), body.format(f="add", p="a", q="b", x="c", y="é")
    assert same_tokens(one, two)
    assert same_tokens(one, two.replace("c += é", "c+=é  # more").replace("return c", "\n    return (c)"))
    assert not same_tokens(one, two.replace("return c", "return a"))
    for uncertain in ("eval(x)", "global g", "g = lambda: 0", "[k for k in (1,)]"):
        spoilt = [s.replace("    return", f"    {uncertain}\n    return") for s in (one, two)]
        assert not same_tokens(*spoilt), uncertain


def test_everything_else_matters_to_runs():
    for one, two in [("8", "8.0"), ("0x8", "8"), ("1", "True"), ('"t"', "'t'"), ("bed", "pot"), ("bed.left", "bed.right"), ("dig(deep=1)", "dig(wide=1)"), ("bed - 1", "bed + 1"), ("f'{bed!r}'", "f'{bed!a}'")]:
        assert not same_tokens(f"rest()\nspot = {one}\n", f"rest()\nspot = {two}\n"), (one, two)
        assert same_tokens(f"rest()\nspot = {one}\n", f"rest( )\n\nspot={one} # here\n")


def test_symbols_imports_and_dispatch():
    unit = Parsed(b"@d\nclass C:\n    def f(self): ...\ndef g(): ...\n")
    found = declarations.symbols(unit)
    assert [(s["qualified_name"], s["start_line"]) for s in found] == [("C", 1), ("C.f", 3), ("g", 4)]
    same = declarations.symbols(Parsed(b"def h(): ...\n"))[0]
    assert same["rename_fingerprint"] == found[2]["rename_fingerprint"] and same["ast_fingerprint"] != found[2]["ast_fingerprint"]
    unit = Parsed(b"import a.b\nfrom .. import c\nfrom d import *\ndef f():\n    from e import g\nif TYPE_CHECKING:\n    import t\n__import__('x')\n")
    got = [(i["target"], i["name"], i["level"], i["execution"], i["guards"], i["reason"]) for i in declarations.imports(unit)]
    assert got == [
        ("a.b", None, 0, "eager", [], None),
        (None, "c", 2, "eager", [], None),
        ("d", None, 0, "eager", [], "star"),
        ("e", "g", 0, "deferred", [], None),
        ("t", None, 0, "eager", ["type-checking"], None),
        (None, None, 0, "eager", [], "dynamic"),
    ]
    unit = Parsed(b"def f(x):\n    if x.state == 'a' and not x.state in ('c', 'b'):\n        assert 'z' != x.state\n")
    assert [(d["operator"], d["values"], d["context"]) for d in declarations.state_dispatch(unit)] == [("eq", ["a"], "condition"), ("in", ["b", "c"], "condition"), ("ne", ["z"], "assertion")]


def test_detectors():
    source = b"def fetch(c):\n    try:\n        r = c.read()\n    except OSError:\n        return []\n    return r\n"
    assert [(h["state"], h["fallback_kind"]) for h in detectors.error_fallbacks(Parsed(source))] == [("assessed", "empty-list")]
    control = b"def f(c, x):\n    try:\n        r = c()\n    except OSError:\n        if x:\n            return []\n        return None\n    return r\ndef g(c):\n    try:\n        return c()\n    except OSError:\n        raise\n"
    assert [(h["state"], h["reason"], h["fallback_kind"]) for h in detectors.error_fallbacks(Parsed(control))] == [("unresolved", "control-flow", None), ("assessed", None, None)]
    source = (
        b"from enum import Enum\nfrom typing import Literal\nclass M(Enum):\n    ON = 1\n    OFF = 2\ndef p(m: M):\n    match m:\n        case M.ON:\n            return 1\n"
        b"def q(m: M):\n    match m:\n        case M.ON:\n            return 1\n        case _:\n            return 0\ndef r(m: M):\n    match m:\n        case M.ON | M.OFF:\n            return 1\n"
        b'Choice = Literal["yes", "no"]\ndef s(c: Choice):\n    match c:\n        case "yes":\n            return 1\n'
    )
    assert [(v["outcome"], v["missing"]) for v in detectors.variants(Parsed(source))] == [("missing", ["M.OFF"]), ("fallback", ["M.OFF"]), ("exhaustive", []), ("missing", ["'no'"])]
    source = b"def w():\n    items = [1]\n    count = len(items)\n    items.append(2)\n    return count\n"
    assert [(d["derived"], d["operation"]) for d in detectors.derived_state(Parsed(source))] == [("count", "append")]
    source = (
        b'from dataclasses import dataclass\n@dataclass\nclass Item:\n    on: bool\n    v: str | None\n    def __post_init__(self):\n        if self.on and self.v is None:\n            raise ValueError("x")\n'
        b'def a(i: Item):\n    if i.on and i.v is None:\n        return 1\ndef b(o: "Item"):\n    if o.on and o.v is None:\n        return 2\n'
    )
    assert [(m["model"], m["consumers"]) for m in detectors.coupled_models(Parsed(source))] == [("Item", ["a", "b"])]


def lengths(*lines):
    return [(d["state"], d["reason"] or d["derived"], d["operation"]) for d in detectors.derived_state(Parsed(inside(*lines).encode()))]


def test_lengths_of_known_lists_only():
    start = ("pots = [1, -2]", "n = len(pots)")
    assert lengths(*start, "pots.append(3)", "m = n", "return m") == [("assessed", "n", "append")]
    assert lengths(*start, "pots.insert(0, 3)", "pots.append(4)", "return (n, 1)") == [("assessed", "n", "insert")]
    assert lengths(*start, "pots.extend([])", "return n") == [] == lengths(*start, "return n") == lengths("pots = row", "return pots")
    assert lengths(*start, "pots.append(3)", "n = len(pots)", "return n") == []
    for more, why in [
        (("beds = pots", "return n"), "possible-alias"), (("pots = [5]", "return n"), "rebound-list"), (("pots.extend(row)", "return n"), "unsupported-mutation"), (("dig(pots)", "return n"), "unknown-call"),
        (("if row:", "    pots.append(1)", "return n"), "control-flow"), (("return n + 1",), "unsupported-read"),
    ]:
        assert lengths(*start, *more) == [("unresolved", why, None)], more
    assert lengths("n = len(row)", "return n") == [("unresolved", "unknown-call", None)]
    shadowed = "def len(x): return 0\n" + inside(*start, "return n")
    assert [d["reason"] for d in detectors.derived_state(Parsed(shadowed.encode()))] == ["shadowed-builtin"]


MODEL = """from dataclasses import dataclass
@dataclass
class Bed:
    dug: bool
    crop: str | None
    def __post_init__(self):
        'Docs'
        if self.dug and self.crop is None:
            raise ValueError
def plant(bed: Bed):
    if bed.dug and bed.crop is None:
        return 1
def water(row, *, bed: "Bed"):
    if bed.dug and bed.crop is None:
        return 2
"""


def test_models_whose_check_is_repeated_at_once():
    judged = lambda source: [(m["state"], m["reason"], m["guard"], m["consumers"]) for m in detectors.coupled_models(Parsed(source.encode()))]
    guard = "(_.dug and _.crop is None)"
    assert judged(MODEL) == [("assessed", None, guard, ["plant", "water"])]
    late = MODEL.replace("def plant(bed: Bed):\n", "def plant(bed: Bed):\n    dig()\n")
    assert judged(late) == [("assessed", None, None, ["water"])]
    for old, new in (("return 1", "bed = 1"), ("def plant", "@memo\ndef plant"), ("return 1", "return lambda: 1"), ("bed.dug and bed.crop is None:\n        return 1", "bed.dug or bed.crop is None:\n        return 1")):
        assert judged(MODEL.replace(old, new)) == [("assessed", None, None, ["water"])], new
    for old, new, why in (
        ("class Bed:", "class Bed(Soil):", "unsupported-model"), ("from dataclasses import dataclass", "import dataclasses\nfrom other import dataclass", "unsupported-decorator"), ("dug: bool", "dug: int", "unsupported-field"),
        ("def plant", "Bed = 1\ndef plant", "ambiguous-name"), ("    dug: bool", "    def __init__(self): ...\n    dug: bool", "custom-construction"),
    ):
        assert [x[:2] for x in judged(MODEL.replace(old, new, 1))] == [("unresolved", why)], new


def test_problems():
    with pytest.raises(Problem) as found:
        Parsed(b"def f(:\n")
    assert found.value.code == "python.parse-error" and found.value.start_line == 1
    with pytest.raises(Problem) as found:
        Parsed(b"# coding: nope\n")
    assert found.value.code == "python.decode-error"


def test_extract_isolates_failures(spark):
    from codestrata.extract import families

    rows = [("a.py", bytearray(b"x = 1\n"), "python"), ("bad.py", bytearray(b"def f(:\n"), "python"), ("c.x", bytearray(b""), "other"), ("n.py", None, "python")]
    got = {r.path: r for r in families.extract(spark.createDataFrame(rows, "path string, content binary, language string")).collect()}
    assert {k: r.parse_state for k, r in got.items()} == {"a.py": "parsed", "bad.py": "failed", "c.x": "unsupported", "n.py": "parsed"}
    assert got["a.py"].sloc == 1 and got["bad.py"].diagnostic.code == "python.parse-error"
