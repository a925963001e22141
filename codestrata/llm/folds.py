"""Folds by CRC-32 of the decimal id, and plain names for any columns: shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_is(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32(id as text) mod ``folds`` is ``fold``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sampled(id_col: str, share: Column, salt: int) -> Column:
    """True for a fixed pseudo-random ``share`` of ids."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with names for its columns that clash with no other and that every function takes; ``toDF`` names them back."""
    return df.toDF(*(f"column{k}" for k in range(len(df.columns))))
