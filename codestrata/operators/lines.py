"""Line sets: spans to lines, unions and intersections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_lines(spans: DataFrame, lines: DataFrame, key: list[str], *, start: str = "start_line", end: str = "end_line", line: str = "line") -> DataFrame:
    """Rows of ``spans`` with each line of ``lines`` inside them.

    A span is dealt out into its own line numbers and joined by equality, so no task compares all spans of a file with
    all its lines.
    """
    dealt = spans.filter(F.col(start) <= F.col(end)).withColumn(line, F.explode(F.sequence(F.col(start), F.col(end))))
    return dealt.join(lines.select(*key, line).distinct(), [*key, line])


def line_set(spans: DataFrame, lines: DataFrame, key: list[str], **columns: str) -> DataFrame:
    """The distinct lines inside any of the spans: overlaps count once."""
    return span_lines(spans, lines, key, **columns).select(*key, columns.get("line", "line")).distinct()


def union_lines(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out.distinct()


def overlapping_spans(left: DataFrame, right: DataFrame, key: list[str], *, bin_lines: int = 64) -> DataFrame:
    """Pairs of spans of the same key that share a line (D7).  Columns of both sides are prefixed ``l_`` and ``r_``.

    Spans are binned by line number and joined on the bin; a pair is kept in the first bin that it shares.
    """

    def binned(df: DataFrame, prefix: str) -> DataFrame:
        df = df.select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in key])
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{prefix}_start_line") / bin_lines), F.floor(F.col(f"{prefix}_end_line") / bin_lines))))

    both = binned(left, "l").join(binned(right, "r"), [*key, "bin"])
    first = F.floor(F.greatest("l_start_line", "r_start_line") / bin_lines)
    return both.filter((F.col("l_start_line") <= F.col("r_end_line")) & (F.col("l_end_line") >= F.col("r_start_line")) & (F.col("bin") == first)).drop("bin")


def enclosing_spans(inner: DataFrame, outer: DataFrame, key: list[str], **options: int) -> DataFrame:
    """Pairs in which the right span encloses the left one (D8), equal spans included."""
    return overlapping_spans(inner, outer, key, **options).filter("r_start_line <= l_start_line AND r_end_line >= l_end_line")
