"""Graph operators on edge tables.

All of them iterate over DataFrames whose rounds are written down by ``checkpoint()`` in the folder that driver and
executors share; only counts and one checksum a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import own_folder, shared_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first())


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written down and read again.  Unlike a checkpoint, what is read has no partitioning that a join would stick to:
    it is dealt out anew, so that adaptive execution can broadcast it or split its skewed keys."""
    folder = own_folder(df.sparkSession, "graph")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges`` has columns ``a`` and ``b`` of one orderable type; gives ``node, component`` with the least node of
    each component, for every node that has an edge to another (loops, repeats and nulls do no harm).

    Alternating star contractions: in a round, the larger neighbours of each node go to the least node nearby, then the
    smaller ones do.  Minima by key have partial sums; they are written down before the edges are joined to them, so that the
    rows of a node with very many neighbours can be split over tasks.  The number of rounds grows with the logarithm of the
    longest chain.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    edges = _stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = _stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = _stored(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v")
        edges = _stored(small.distinct())
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = now
    raise RuntimeError("components did not settle")


def module_graph(modules: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (analyzed modules and ends of edges) and distinct edges of internal imports."""
    edges = imports.select("importer", "imported").distinct()
    nodes = modules.select("module").union(edges.select("importer")).union(edges.select("imported")).distinct()
    return nodes, edges


def fan_out(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct imported modules by module, 0 where there are none."""
    nodes, edges = module_graph(modules, imports)
    counts = edges.groupBy(F.col("importer").alias("module")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("fan_out"))


def trim_acyclic(edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """The edges left after taking away, up to ``max_rounds`` times, nodes without an edge in or out: all cycles survive."""
    shared_dir(edges.sparkSession)
    edges = edges.select("importer", "imported").distinct().checkpoint()
    n = edges.count()
    for _ in range(max_rounds):
        starts, ends = edges.select(F.col("importer").alias("imported")).distinct(), edges.select(F.col("imported").alias("importer")).distinct()
        edges = edges.join(starts, "imported", "left_semi").join(ends, "importer", "left_semi").select("importer", "imported").checkpoint()
        now = edges.count()
        if now == n:
            break
        n = now
    return edges


def cycles(edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """Strongly connected components of more than one node, or of one with an edge to itself (J2): ``module, cycle`` (the
    least module of the component).

    Least labels are passed forwards and backwards along the edges until nothing moves: the nodes that reach the least node
    of their region and are reached by it are its component; it is set aside, edges between nodes of different labels are on
    no cycle, and the rest goes on.  Each pass settles at least one component of each region, so there is no bound on the
    passes.  Nodes that lie on no cycle are trimmed first (in ``max_rounds`` rounds at most, which only saves work).
    """
    spark = edges.sparkSession
    shared_dir(spark)
    kind = edges.schema["importer"].dataType.simpleString()
    loops = edges.filter("importer = imported").select(F.col("importer").alias("module"), F.col("importer").alias("cycle")).distinct()
    left = trim_acyclic(edges.filter("importer <> imported"), max_rounds=max_rounds)
    found = spark.createDataFrame([], f"module {kind}, cycle {kind}")

    def spread(edges: DataFrame, source: str, target: str) -> DataFrame:
        """For each node the least node that reaches it along the edges from ``source`` to ``target``.

        Each node also takes the label of one node that reaches it, ``jump``, which doubles its distance in each round, so
        that long rings settle in a logarithm of their length."""
        nodes = edges.select(F.col("importer").alias("node")).union(edges.select("imported")).distinct()
        jumps = edges.groupBy(F.col(target).alias("node")).agg(F.min(source).alias("jump"))
        label = nodes.join(jumps, "node", "left").select("node", F.col("node").alias("label"), F.coalesce("jump", "node").alias("jump")).checkpoint()
        state = None
        while (now := _state(label.select("node", "label"))) != state:
            state = now
            moved = edges.join(label.select(F.col("node").alias(source), "label"), source).select(F.col(target).alias("node"), "label")
            ahead = label.select(F.col("node").alias("jump"), F.col("label").alias("far_label"), F.col("jump").alias("far_jump"))
            jumped = label.join(ahead, "jump").select("node", F.least("label", "far_label").alias("label"), F.col("far_jump").alias("jump"))
            both = jumped.unionByName(moved, allowMissingColumns=True)
            label = both.groupBy("node").agg(F.min("label").alias("label"), F.min("jump").alias("jump")).checkpoint()
        return label.select("node", "label")

    while not left.isEmpty():
        forward = spread(left, "importer", "imported").withColumnRenamed("label", "first")
        backward = spread(left, "imported", "importer").withColumnRenamed("label", "last")
        labels = forward.join(backward, "node").checkpoint()
        found = found.union(labels.filter("first = last").select("node", F.col("first").alias("cycle")))
        rest = labels.filter("first <> last")
        left = left.join(rest.select(F.col("node").alias("importer"), "first", "last"), "importer").join(rest.select(F.col("node").alias("imported"), "first", "last"), ["imported", "first", "last"])
        left = trim_acyclic(left, max_rounds=max_rounds)
    several = found.groupBy("cycle").count().filter("count > 1").select("cycle")
    found = found.join(several, "cycle", "left_semi").select("module", "cycle")
    return found.union(loops.join(found, "module", "left_anti")).distinct()


def policy_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Direct edges whose ends lie within a forbidden pair of prefixes.

    The names' own prefixes are dealt out and joined by equality, so no edge is compared with rules that cannot match.
    ``rules``: source, target.
    """
    from ..functions.globs import prefixes

    distinct = edges.select("importer", "imported").distinct()
    dealt = distinct.withColumn("source", F.explode(prefixes(F.col("importer"))))
    by_source = dealt.join(rules.select("source", "target").distinct(), "source")
    inside = (F.col("imported") == F.col("target")) | F.col("imported").startswith(F.concat("target", F.lit(".")))
    return by_source.filter(inside).select("importer", "imported", "source", "target")
