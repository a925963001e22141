"""A generated source tree for timing (T1): straight-line functions of ten lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import Snapshot


def generated_inventory(spark: SparkSession, files: int = 100, functions: int = 100) -> DataFrame:
    """An inventory of ``files`` files with ``functions`` functions each, made by SQL on the executors."""
    body = " || ".join(f"concat('    step_{k} = step_{k - 1} + ', cast({k} + f AS string), '\\n')" for k in range(1, 9))
    one = f"concat('def function_', id, '_', f, '(step_0):\\n', {body.replace(' || ', ', ')}, '    return step_8\\n')"
    text = F.expr(f"array_join(transform(sequence(1, {functions}), f -> {one}), '')")
    rows = spark.range(0, files, 1, min(files, 4 * spark.sparkContext.defaultParallelism)).withColumn("text", text)
    return rows.select(
        F.format_string("package/module_%04d.py", "id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit("python").alias("language"), F.lit(False).alias("is_symlink"),
        F.lit(False).alias("git_ignored"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("read_error"),
    )


def scan_generated(spark: SparkSession, files: int = 100, functions: int = 100) -> DataFrame:
    """Metrics of the generated tree, through the whole of a scan."""
    return Snapshot(generated_inventory(spark, files, functions)).metrics()
