"""Line alignment of two versions of a file (family I: line diff; H4).

The alignment is that of the standard library's ratio-based matcher over whole byte lines (no junk heuristics): longest
matching block first, then left and right of it.  Line ends CRLF and CR count as LF, and a last line end opens no line.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

ALIGNED = "aligned array<struct<old:int,new:int>>, added array<int>, deleted array<int>"


def byte_lines(content: bytes | None) -> list[bytes]:
    if not content:
        return []
    lines = bytes(content).replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


def align_lines(old: bytes | None, new: bytes | None) -> list[tuple[int, int]]:
    """Pairs of 1-based line numbers of equal, aligned lines."""
    a, b = byte_lines(old), byte_lines(new)
    if a == b:
        return [(i, i) for i in range(1, len(a) + 1)]
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return [(x.a + k + 1, x.b + k + 1) for x in blocks for k in range(x.size)]


def line_delta(old: bytes | None, old_lines: list[int], new: bytes | None, new_lines: list[int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Added and deleted code-bearing lines, and the aligned pairs that bear code on both sides.

    A line whose text stays but which bears code on one side only counts as added or deleted there.
    """
    before, after = set(old_lines), set(new_lines)
    kept = [(i, j) for i, j in align_lines(old, new) if i in before and j in after]
    return sorted(after - {j for _, j in kept}), sorted(before - {i for i, _ in kept}), kept


def with_line_deltas(pairs: DataFrame, *, before: str = "before", old_lines: str = "old_lines", after: str = "after", new_lines: str = "new_lines") -> DataFrame:
    """``pairs`` with columns ``aligned``, ``added`` and ``deleted``.  Missing sides (null) have no lines."""
    from pyspark.sql.types import StructType

    where = [pairs.columns.index(c) for c in (before, old_lines, after, new_lines)]
    schema = StructType([*pairs.schema.fields, *StructType.fromDDL(ALIGNED).fields])
    pair = pa.list_(pa.struct([("old", pa.int32()), ("new", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i).to_pylist() for i in where]
            out = [line_delta(a, m or [], b, n or []) for a, m, b, n in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([[{"old": i, "new": j} for i, j in kept] for _, _, kept in out], pair),
                    pa.array([added for added, _, _ in out], pa.list_(pa.int32())),
                    pa.array([deleted for _, deleted, _ in out], pa.list_(pa.int32())),
                ],
                names=schema.fieldNames(),
            )

    return pairs.mapInArrow(run, schema)
