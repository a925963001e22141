"""Identity of contents and of structured values (family I: hash)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def content_hash(content: Column) -> Column:
    """SHA-256 of exact bytes, 64 lower-case hex digits."""
    return F.sha2(content.cast("binary"), 256)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, ASCII escapes: the same text for the same value on any side."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode("ascii")).hexdigest()


@pandas_udf(StringType())
def json_digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of the canonical form of JSON texts (what ``to_json`` gives is not canonical)."""
    for series in texts:
        yield series.map(lambda t: None if t is None else canonical_digest(json.loads(t)))


def token_fingerprint(tokens: Column) -> Column:
    """SHA-256 of a token array; the lengths keep ``['ab', 'c']`` and ``['a', 'bc']`` apart."""
    return F.sha2(F.array_join(F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), ";").cast("binary"), 256)


def short_id(kind: str, digest: Column, length: int = 20) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(digest, 1, length))
