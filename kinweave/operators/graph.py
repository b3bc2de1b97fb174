"""Graph operators: connected components by alternating large and small stars, and what builds on them."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names (spark.checkpoint.dir). A local one stands in only in local mode, as in tests; on a cluster it is an error to name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="kinweave-")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: So many edges are a single task's work of a second; beyond that the rounds below take over.
SMALL = 50_000


def _forest(batches):
    """(node, root) of the edges of one task."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    if kind is not None:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node of the component.

    Each round hangs larger neighbours on the smallest one, first in the whole neighbourhood, then
    among smaller neighbours; the rounds are logarithmic in the longest path. A hub's rows meet in
    joins that AQE can split, and minima are combined before the shuffle. Edges with a null end are
    ignored; a loop makes its node a component of its own. At most ``small`` edges are walked by one task.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    loops = ends.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    star = ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star, before = checkpointed(star.distinct()), None
    if small and star.limit(small + 1).count() <= small:
        kind = star.schema["u"].dataType.simpleString()
        found = star.repartition(1).mapInArrow(_forest, f"node {kind}, root {kind}")
        return found.unionByName(loops.join(star.select(F.col("u").alias("node")).union(star.select("v")), "node", "left_anti").distinct())
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    members = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("root"))
    found = members.unionByName(roots.distinct())
    return found.unionByName(loops.join(found, "node", "left_anti").distinct())
