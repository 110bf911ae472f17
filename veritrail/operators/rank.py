"""Scores, time priors, and the node set of an answer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import role
from ..schema import HOP_DECAY, RECENCY_DAYS, RECENCY_PENALTY
from ..session import settled


def scaled(hits: DataFrame, value: str = "relevance") -> DataFrame:
    """Adds ``scaled``: the value over the query's largest; neutral 1 where there is none."""
    most = F.max(value).over(Window.partitionBy("query_id"))
    return hits.withColumn("scaled", F.coalesce(F.when(most > 0, F.col(value) / most), F.lit(1.0)))


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def window_prior(created: Column, since: Column, until: Column) -> Column:
    """1 at the middle of the window, falling with the distance in half-windows."""
    centre = (seconds(since) + seconds(until)) / 2
    half = F.greatest((seconds(until) - seconds(since)) / 2, F.lit(1.0))
    return 1.0 / (1.0 + F.abs(seconds(created) - centre) / half)


def recency_prior(created: Column, now: datetime | Column) -> Column:
    """1 for new documents, falling to 1 - RECENCY_PENALTY at RECENCY_DAYS; the future is new."""
    now = now if isinstance(now, Column) else F.lit(now)
    age = F.greatest(seconds(now) - seconds(created), F.lit(0.0)) / (RECENCY_DAYS * 86400.0)
    return 1.0 - RECENCY_PENALTY * F.least(age, F.lit(1.0))


def walked_score(hops: Column, confidence: Column, relevance: Column | None = None, prior: Column | None = None) -> Column:
    out = F.pow(F.lit(HOP_DECAY), hops) * confidence
    for factor in (relevance, prior):
        out = out if factor is None else out * factor
    return out


def node_set(stages: list[DataFrame], documents: DataFrame) -> DataFrame:
    """One row for each document of a query, from stages in order of precedence.

    Each stage has ``query_id, node, position, role, score, hops, excerpt``; a null role is
    taken from the document's type. The first insertion of a document counts (an aggregate,
    combined before its shuffle), and only then are those without an address left out, so
    such a document still blocks a later row of its id.
    """
    union = None
    for n, stage in enumerate(stages):
        part = stage.withColumn("stage", F.lit(n)).withColumn("position", F.col("position").cast("bigint"))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in ("query_id", "node")]
    first = F.min_by(F.struct(*rest), F.struct("stage", "position")).alias("r")
    one = union.groupBy("query_id", "node").agg(first).select("query_id", "node", *(F.col(f"r.{c}").alias(c) for c in rest))
    known = documents.select(F.col("doc_id").alias("node"), "source", "type", "title", "url", "created_at")
    found = one.join(known, "node").where(F.coalesce(F.col("url"), F.lit("")) != "")
    return found.withColumn("role", F.coalesce("role", role(F.col("type"))))


def numbered(rows: DataFrame, order: list[Column], groups: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group, from 1, without one task for a group: rows are
    dealt by ranges of the whole order and settled, each range numbers its own, and what the
    ranges before it hold of a group, one number a range and group, is added."""
    keys = [*map(F.col, groups), *order]
    dealt = settled(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    out = dealt.withColumn(name, own).join(F.broadcast(sums), [*groups, "_range"])  # a row for each range and group in it: at most their sum
    return out.withColumn(name, (F.col(name) + F.col("_first")).cast("bigint")).drop("_range", "_first")


def by_rank(nodes: DataFrame) -> DataFrame:
    return numbered(nodes, [F.desc("score"), F.desc("created_at"), F.asc("node")], ("query_id",))


def by_time(nodes: DataFrame) -> DataFrame:
    return numbered(nodes, [F.asc("created_at"), F.asc("node")], ("query_id",))
