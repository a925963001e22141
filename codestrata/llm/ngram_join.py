"""Similarity join of documents on their word n-grams: MinHash banding, then exact verification (operator 2).

1.  Every text becomes its set of word n-grams, a key of that set, and a signature of ``bands`` x ``rows`` minima.  Texts
    with equal sets are one class from here on, so a copied text counts once.
2.  Classes are shuffled on band hashes.  Inside a bucket, signatures are compared and only a star from each group of
    likely partners to its least member leaves the task, never a pair for each two members; a bucket of more than
    ``block`` classes is dealt out as pairs of blocks.
3.  The stars' connected components are the clusters.  Each class of a cluster sends its whole n-gram set there once;
    pairs of blocks of a cluster compute all intersections exactly.  Out come each class's number of links and again a
    star per group of truly similar classes.  Components of these stars are the result.

``bands`` and ``rows`` follow from the target recall: a pair at the threshold s shares a band with a chance of
1 - (1 - s^rows)^bands.  The comparison of signatures in step 2 lets through everything whose estimate is at least
``slack`` x threshold, some five standard deviations below it, so that it costs no further recall to speak of (both are
measured against brute force in the tests).  All pairs of a cluster are compared, for the numbers of links are exact: that
work grows with the square of a cluster of different texts, in blocks that tasks share out; equal texts cost nothing.

Defined cases: a null text or one without a word has no n-grams, no links, and a class of its own; a text shorter than n
words has one n-gram, all its words; equal texts are linked to each other and are expanded nowhere; null and repeated
ids are ids like others (the least non-null id of a group names it); a similarity of just the threshold links; a text of any
length is read whole; an empty table gives an empty result; only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import shared_dir
from .shingles import mix, ngram_set
from .threads import one_thread, release_memory

_NO_EDGE = "a binary, b binary"


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands with which a pair at ``threshold`` is found with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(grams: np.ndarray, n: int) -> np.ndarray:
    """``n`` 32-bit minima of a non-empty set."""
    factors, low = _multipliers(n), (grams >> np.uint64(16)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 4096):
            np.minimum(best, (low[at : at + 4096, None] * factors).min(axis=0), out=best)
    return best


def low_bytes(least: np.ndarray) -> bytes:
    """A byte of each minimum: of different minima two are equal by chance, 1 in 256, however small minima of many n-grams
    are, which their top bytes are not."""
    with np.errstate(over="ignore"):
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, *, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """``id, text_hash, key`` (of the set; null without words)``, n_grams, band`` (hashes) ``, sketch`` (a byte for each
    minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, band, sketch = [], [], [], []
            for text in batch.column(2):
                grams = ngram_set((text.as_py() or "").encode("utf-8"), n)
                sizes.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    band.append(None)
                    sketch.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                least = signature(grams, bands * rows)
                hashes = np.arange(bands, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for part in least.reshape(bands, rows).T.astype(np.uint64):
                        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + part)
                band.append(hashes.view(np.int64))
                sketch.append(low_bytes(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "text_hash", "key", "n_grams", "band", "sketch"],
            )
        release_memory()

    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, text_hash long, key binary, n_grams int, band array<long>, sketch binary")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, as one list per run of equal first ``width`` columns."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, run in groupby(rows(), key=lambda r: r[:width]):
        yield list(run)


def _stars(linked: np.ndarray, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For each component of a symmetric boolean matrix: its other members with the least one."""
    n, label = len(keys), [-1] * len(keys)
    out = []
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front, members = i, [i], [i]
        seen = linked[i].copy()
        seen[i] = True
        new = np.flatnonzero(seen & (np.arange(n) != i))
        while len(new):
            members += new.tolist()
            reach = linked[new].any(axis=0) & ~seen
            seen |= reach
            new = np.flatnonzero(reach)
        del front
        for m in members:
            label[m] = i
        if len(members) > 1:
            least = min(keys[m] for m in members)
            out += [(keys[m], least) for m in members if keys[m] != least]
    return out


def _edge_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])


def _likely(least: float):
    """Stars of likely partners in each bucket (or pair of its blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[bytes, bytes]] = []
        for rows in _runs(batches, 3):
            keys = [r[3] for r in rows]
            table = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
            want = least * table.shape[1]
            if len(rows) == 2:
                if (table[0] == table[1]).sum() >= want:
                    pairs.append((max(keys), min(keys)))
            elif len(rows) > 2:
                same = np.zeros((len(rows), len(rows)), np.int16)
                for column in table.T:
                    same += column[:, None] == column
                pairs += _stars(same >= want, keys)
            if len(pairs) > 20_000:
                yield _edge_batch(pairs)
                pairs = []
        if pairs:
            yield _edge_batch(pairs)

    return run


def _in_blocks(rows: DataFrame, group: str, blocks: str, key: str, keep: list[str]) -> DataFrame:
    """Deals the rows of each group out to all pairs of its blocks, ``x <= y``: one row for each pair it is part of."""
    own = F.expr(f"cast(pmod(xxhash64({key}, {group}), {blocks}) AS int)")
    pairs = F.expr(f"transform(sequence(0, {blocks} - 1), o -> struct(least(o, own) AS x, greatest(o, own) AS y))")
    return rows.withColumn("own", own).select(group, F.explode(pairs).alias("pair"), "own", key, *keep).select(group, "pair.x", "pair.y", key, *keep, "own")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ``sets``, by products of 0/1 matrices over slices of the shared n-grams."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    column = np.concatenate([[0], np.cumsum(grams[1:] != grams[:-1])])
    shared = np.bincount(column) > 1
    use = shared[column]
    owner, column = owner[use], (np.cumsum(shared) - 1)[column[use]]
    total = np.zeros((n, n), np.float32)
    columns = int(shared.sum())
    width = min(columns, max(256, 8_000_000 // n))
    for at in range(0, columns, max(1, width)):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return total


def _verified(threshold: float):
    """Exact links inside each pair of blocks: numbers of linked texts by class (``b`` null), and stars (``links`` 0)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, links = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        out: list[tuple] = []
        for rows in _runs(batches, 3):
            x, y = rows[0][1:3]
            keys, copies, own = [r[3] for r in rows], np.array([r[4] for r in rows]), np.array([r[6] for r in rows])
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            size = np.array([len(s) for s in sets], np.float64)
            both = _counts(sets).astype(np.float64)
            linked = both >= threshold * (size[:, None] + size - both) - 1e-9
            np.fill_diagonal(linked, False)
            if x != y:  # pairs inside a block belong to that block with itself
                linked &= own[:, None] != own
            links = linked @ copies
            out += [(k, None, int(n)) for k, n in zip(keys, links, strict=True) if n]
            out += [(a, b, 0) for a, b in _stars(linked, keys)]
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def _gram_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set((t.as_py() or "").encode("utf-8"), n).tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "grams"])

    return run


def _classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    rows: int = 5,
    recall: float = 0.9999,
    slack: float = 0.75,
    block: int = 1024,
    block_grams: int = 4_000_000,
) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each key: ``copies``, ``class_id``, ``keeper`` (id and text hash of the row that
    stands for its group) and ``n_links``."""
    bands = bands_for(threshold, rows, recall)
    shared_dir(docs.sparkSession)
    sketch = sketches(docs, id_col=id_col, text_col=text_col, n=n, bands=bands, rows=rows).checkpoint()

    classes = (
        sketch.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("least_id"),
            F.min(F.struct("id", "text_hash")).alias("sample"),
            F.min("n_grams").alias("n_grams"),
            F.min("sketch").alias("sketch"),
            F.min("band").alias("band"),
        )
        .checkpoint()
    )
    in_band = classes.select(F.explode("band").alias("bucket"), "key")
    full = in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    active = in_band.join(full, "bucket").join(classes.select("key", "sketch"), "key")
    dealt = _in_blocks(active.withColumn("blocks", F.expr(f"cast(ceil(members / {block}) AS int)")), "bucket", "blocks", "key", ["sketch"])
    likely = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "key").drop("own").mapInArrow(_likely(slack * threshold), _NO_EDGE)
    clusters = connected_components(likely).withColumnsRenamed({"node": "key", "component": "cluster"})

    members = classes.select("key", "copies", "sample", "n_grams").join(clusters, "key")
    sizes = members.groupBy("cluster").agg(F.expr(f"cast(greatest(ceil(count(*) / {block}), ceil(sum(n_grams) / {block_grams})) AS int)").alias("blocks"))
    members = members.join(sizes, "cluster").select("cluster", "blocks", "key", "copies", F.col("sample.id").alias("id"), F.col("sample.text_hash").alias("text_hash"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    whole = (
        members.join(texts.hint("shuffle_merge"), (members.text_hash == texts.text_hash) & members.id.eqNullSafe(texts.id))
        .select("cluster", "blocks", "key", "copies", "text")
        .mapInArrow(_gram_sets(n), "cluster binary, blocks int, key binary, copies long, grams binary")
        .dropDuplicates(["key"])
    )
    pairs = _in_blocks(whole, "cluster", "blocks", "key", ["copies", "grams"])
    verified = (
        pairs.repartition("cluster", "x", "y")
        .sortWithinPartitions("cluster", "x", "y", "key")
        .mapInArrow(_verified(threshold), "a binary, b binary, links long")
        .checkpoint()
    )
    links = verified.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "key")
    groups = connected_components(verified.filter("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "key", "component": "group"})

    named = classes.select("key", "copies", "least_id", "sample").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    least = named.groupBy("group").agg(F.min("least_id").alias("class_id"), F.min("sample").alias("keeper"))
    per_class = named.join(least, "group").join(links, "key", "left").select("key", "class_id", "keeper", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketch, per_class


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its connected component of links) and ``n_links`` (how
    many other rows have a Jaccard similarity of at least ``threshold`` with it, copies included).

    Options: ``n, threshold, rows, recall, slack``, and ``block`` and ``block_grams``, which bound what one task compares
    at a time; larger groups are dealt out in pairs of blocks.
    """
    sketch, per_class = _classes(docs, id_col=id_col, text_col=text_col, **options)
    return sketch.select("id", "key").join(per_class, "key", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).cast(docs.schema[id_col].dataType).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of linked texts (the one with the
    least id).  Texts without a word all stay, but of rows with equal id and text only one does."""
    sketch, per_class = _classes(docs, id_col=id_col, text_col=text_col, **options)
    keepers = per_class.select("keeper").distinct().select("keeper.*").unionByName(sketch.filter("key IS NULL").select("id", "text_hash"))
    # The row travels as one field, so that no name of its columns can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))
    kept = rows.join(keepers.hint("shuffle_merge"), (F.col("row_hash") == keepers.text_hash) & F.col("row_id").eqNullSafe(keepers.id), "left_semi")
    if not sketch.groupBy("id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row_id", "row_hash"])
    return kept.select("row.*")
