"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts by itself, about.
EDGES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of any orderable type to ``(node, root)``, root the smallest
    node of the component; nodes without an edge to another node don't appear.

    First each task contracts the edges of its own partition to trees of depth one, in
    partitions of about EDGES edges that need no shuffle; a graph of one partition is done
    then. Otherwise rounds of a large-star and a small-star step follow: neighbours are
    re-linked to the smallest one seen, so a chain of n nodes takes O(log n) rounds. The
    large-star step aggregates before its shuffle and then joins, so that a hub's rows can
    be split by adaptive execution; nothing but a count and a checksum comes to the driver.
    """
    n = edges.count()
    parts = max(1, n // EDGES)
    current = cut(_contracted(edges, parts))
    before = None
    while parts > 1:
        seen = current.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (seen.n, seen.x) == before:
            break
        before = (seen.n, seen.x)
        current = cut(_small_star(_large_star(current)))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges of each partition as ``(node, smallest node of its part)``, the node the larger."""

    def run(batches):
        parent: dict = {}

        def top(k):
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(k, top(k)) for k in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        for at in range(0, len(rows), 10_000):
            u, v = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, schema.field(0).type), pa.array(v, schema.field(1).type)], names=["u", "v"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(run, edges.select("u", "v").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.repartition("u")  # by the larger end, which a hub isn't
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least).distinct()
