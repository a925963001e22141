"""Glob predicates on paths (B1, B5, B18): compiled to one anchored regular expression, evaluated by ``rlike``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_regex(segment: str) -> str:
    """One path segment with ``*``, ``?`` and ``[...]``, which never match a slash."""
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = segment.find("]", i + 2 if segment[i + 1 : i + 2] in ("!", "]") else i + 1)
            if j < 0:
                out.append(r"\[")
            else:
                inside = segment[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append(f"[^{inside[1:]}]" if inside.startswith("!") else f"[{inside}]".replace("[^", "[\\^", 1))
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob in which ``**`` stands for any number of whole segments, none included."""
    parts = pattern.replace("\\", "/").split("/")
    out = "^"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
        else:
            out += segment_regex(part) + ("" if last else "(?=/|$)" if parts[k + 1 :] == ["**"] else "/")
            if not last and parts[k + 1 :] == ["**"]:
                out += "/?"
    return out + "$"


def matches_any(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether a path (backslashes count as slashes) matches one of the globs; false for no globs, null for a null path."""
    plain = F.translate(path, "\\", "/")
    if not patterns:
        return F.when(path.isNotNull(), F.lit(False))
    return plain.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def pruned_directories(patterns: list[str] | tuple[str, ...]) -> list[str]:
    """The globs of directories whose contents need not be listed: those of the patterns that end in ``/**``."""
    return [p[: -len("/**")] for p in patterns if p.endswith("/**")]


def within(name: Column, prefix: Column, separator: str = ".") -> Column:
    """Whether a dotted name or path is the prefix itself or lies under it."""
    return (name == prefix) | name.startswith(F.concat(prefix, F.lit(separator)))


def prefixes(name: Column, separator: str = ".") -> Column:
    """All prefixes of a name at the separator, the name included: for equi-joins in place of prefix comparisons."""
    parts = F.split(name, re.escape(separator), -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
