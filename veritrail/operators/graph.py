"""Neighbours and the confidence-pruned walk over typed edges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import WALK_DEPTH, WALK_FLOOR
from ..session import settled
from .store import Tables


#: Rows of a frontier, or of all that a walk has reached, up to which they go to the tasks that
#: hold the edges; of more, edges and frontier are shuffled. A row has a few hundred bytes.
SENT = 50_000


@dataclass(frozen=True)
class StoredEdges:
    """Edges in stored tables, dealt by each of their ends: a walk opens the parts that its frontier
    falls into, in both."""

    tables: Tables

    def steps(self, frontier: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
        hashes = self.tables.touched("edges", frontier, "node")
        out = oriented(self.tables.read("edges", hashes), "out", kinds) if direction != "in" else None
        back = oriented(self.tables.read("edges_in", hashes), "in", kinds) if direction != "out" else None
        return out if back is None else back if out is None else out.unionByName(back)


def oriented(edges: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """Edges as steps ``frm -> to`` with the edge itself; self-loops are left out, and an edge
    that both ends of a frontier touch appears once for each direction."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction!r}")
    rows = edges.where(F.col("src") != F.col("dst"))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    edge = ["src", "dst", "kind", "confidence"]
    out = rows.select(F.col("src").alias("frm"), F.col("dst").alias("to"), *edge)
    back = rows.select(F.col("dst").alias("frm"), F.col("src").alias("to"), *edge)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def neighbours(edges: DataFrame, frontier: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """The edges that touch ``frontier`` (node), each once, by source, target and kind."""
    steps = oriented_with_loops(edges, direction, kinds)
    found = steps.join(frontier.select(F.col("node").alias("frm")).distinct(), "frm", "left_semi")
    return found.select("src", "dst", "kind", "confidence").distinct()


def oriented_with_loops(edges: DataFrame, direction: str, kinds: list[str] | None) -> DataFrame:
    loops = edges.where(F.col("src") == F.col("dst"))
    if kinds:
        loops = loops.where(F.col("kind").isin(*kinds))
    own = loops.select(F.col("src").alias("frm"), F.col("dst").alias("to"), "src", "dst", "kind", "confidence")
    return oriented(edges, direction, kinds).unionByName(own)


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SENT else rows


def walk(
    edges: DataFrame | StoredEdges,
    seeds: DataFrame,
    depth: int = WALK_DEPTH,
    direction: str = "both",
    kinds: list[str] | None = None,
    floor: float = WALK_FLOOR,
    admitted: DataFrame | None = None,
) -> DataFrame:
    """Multi-source breadth-first walk of each query from ``seeds`` (query_id, node, position).

    Returns ``query_id, node, hops, confidence, place, parent, seed, nodes, kinds`` for the
    nodes reached and, with 0 hops, the seeds. A node is reached once, at its fewest hops, by
    the step of the highest confidence (the product along the path; under ``floor`` it is
    pruned); of equals, by the first in frontier order, then edge order. Its own place in the
    next frontier is that of its first sighting. ``admitted`` (node) are nodes that exist and
    may be returned; others are neither returned nor walked through.

    A frontier of at most SENT rows, which is counted, goes to the tasks that hold the edges, so
    edges aren't shuffled, a hub's are read where they lie, and what exists is tested the same way; a larger one is
    joined by a shuffle, in which adaptive execution splits hubs. The best step of a node is an
    aggregate that combines before its shuffle. ``place`` orders a frontier without ranking it:
    the seed's position and, for each hop, the edge of the first sighting, compared item by
    item; so no hop sorts a query's frontier in one task. Each frontier is settled, since the
    next hop, the visited set and the result all read it; a walk ends early when a hop reaches
    nothing.
    """
    reached = seeds.groupBy("query_id", "node").agg(F.min("position").cast("bigint").alias("position"))
    frontier = reached.select(
        "query_id", "node", F.lit(0).alias("hops"), F.lit(1.0).alias("confidence"), F.array(F.lpad(F.col("position").cast("string"), 19, "0")).alias("place"),
        F.lit(None).cast("string").alias("parent"), F.col("node").alias("seed"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("kinds"),
    )
    frontier = everything = settled(frontier)
    n = total = frontier.count()
    for hop in range(1, depth + 1):
        if not n:
            break
        steps = edges.steps(frontier, direction, kinds) if isinstance(edges, StoredEdges) else oriented(edges, direction, kinds)
        step = steps.join(_sent(frontier.withColumnRenamed("confidence", "path"), n), F.col("node") == F.col("frm"))
        fresh = step.join(_sent(everything.select("query_id", F.col("node").alias("to")), total), ["query_id", "to"], "left_anti")
        product = F.col("path") * F.col("confidence")
        fresh = fresh.select(
            "query_id", F.col("to").alias("node"), product.alias("reach"), F.concat("place", F.array("src", "dst", "kind")).alias("place"),
            F.struct(F.col("node").alias("parent"), "seed", "nodes", "kinds", "kind").alias("step"),
        ).where(F.col("reach") >= floor)
        order = F.struct((-F.col("reach")).alias("a"), F.col("place").alias("b"))
        best = fresh.groupBy("query_id", "node").agg(F.min("place").alias("place"), F.max("reach").alias("confidence"), F.min_by("step", order).alias("best"))
        frontier = best.select(
            "query_id", "node", F.lit(hop).alias("hops"), "confidence", "place", F.col("best.parent").alias("parent"), F.col("best.seed").alias("seed"),
            F.concat("best.nodes", F.array("node")).alias("nodes"), F.concat("best.kinds", F.array("best.kind")).alias("kinds"),
        )
        frontier = settled(frontier)
        n = frontier.count()
        if admitted is not None and n:
            # a node is reached or not whatever else is, so what doesn't exist may go after the best steps are known
            there = admitted.join(_sent(frontier.select("node").distinct(), n), "node", "inner" if n <= SENT else "left_semi").select("node").distinct()
            frontier = settled(frontier.join(_sent(there, n), "node", "left_semi").select(*frontier.columns))
            n = frontier.count()
        if n:
            everything, total = everything.unionByName(frontier), total + n
    return everything


def seed_links(edges: DataFrame, seeds: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges between two different seeds of a query."""
    rows = edges.where(F.col("src") != F.col("dst"))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    a = seeds.select("query_id", F.col("node").alias("src")).distinct()
    b = seeds.select("query_id", F.col("node").alias("dst")).distinct()
    return rows.join(a, "src").join(b, ["query_id", "dst"]).select("query_id", "src", "dst", "kind", "confidence")


def admitted(documents: DataFrame, after: datetime | Column | None = None) -> DataFrame:
    """Nodes that exist and, with ``after``, were created later."""
    rows = documents
    if after is not None:
        rows = rows.where(F.col("created_at") > (after if isinstance(after, Column) else F.lit(after)))
    return rows.select(F.col("doc_id").alias("node"))
