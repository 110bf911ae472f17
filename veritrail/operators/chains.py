"""Chains of cited documents and gaps, for all queries at once."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_CHAINS
from ..session import settled
from . import rank

#: What a query without any indexed link is told (wording of our own).
UNLINKED = "no document of this index refers to another, so nothing found here leads anywhere. Sync a source whose documents cite each other, or add a clone of the code"
ALONE = "is not linked to any other result"


def cited(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, hops, place, chain``: each walked path up to its first document that isn't in
    the answer, if two or more are left. Membership is a join of the paths' documents with the
    answer, so neither is collected for a query."""
    walked = paths.where("hops > 0").select("query_id", F.col("node").alias("end"), "hops", "place", "nodes")
    answer = nodes.select("query_id", "node", F.lit(True).alias("known"))
    each = walked.select("query_id", "end", F.posexplode("nodes").alias("at", "node")).join(answer, ["query_id", "node"], "left")
    missing = each.where("known is null").groupBy("query_id", "end").agg(F.min("at").alias("missing"))
    kept = walked.join(missing, ["query_id", "end"], "left").withColumn("keep", F.coalesce("missing", F.size("nodes")))
    return kept.where("keep >= 2").select("query_id", "hops", "place", F.slice("nodes", F.lit(1), F.col("keep").cast("int")).alias("chain"))


def cited_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, src, dst, kind`` of the seeds' links whose two ends are both in the answer."""
    answer = nodes.select("query_id", "node")
    out = links.join(answer.withColumnRenamed("node", "src"), ["query_id", "src"], "left_semi")
    return out.join(answer.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_semi").select("query_id", "src", "dst", "kind")


def joined(chains: list[list[str]], links: list[tuple[str, str]], most: int = MAX_CHAINS) -> list[list[str]]:
    """``chains`` and what links add: a link's source is set before each chain that begins with
    its target, unless it is in it already, round by round until nothing new comes. ``most``
    bounds the joining alone: at that many chains it stops, and chains given are never cut."""
    out, known = list(chains), {tuple(c) for c in chains}
    fresh = list(out)
    while fresh and len(out) < most:
        made = []
        for chain, (source, target) in itertools.product(fresh, links):
            longer = (source, *chain)
            if target == chain[0] and source not in chain and longer not in known and len(out) + len(made) < most:
                known.add(longer)
                made.append([*longer])
        out, fresh = out + made, made
    return out


def reduced(chains: DataFrame) -> DataFrame:
    """Without repeats and chains that are a stretch of a longer one of the query: each chain
    gives its proper stretches, a handful as it has few documents, and those are taken away."""
    distinct = chains.select("query_id", "chain").where(F.size("chain") > 1).distinct()
    n = F.size("chain")
    lengths = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    stretches = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice("chain", i, k))))
    parts = distinct.select("query_id", F.explode(stretches).alias("chain")).distinct()
    return distinct.join(parts, ["query_id", "chain"], "left_anti")


def _lengthened(small: DataFrame, most: int) -> DataFrame:
    """Joins each query's fewer than ``most`` chains (seq, chain, is_link) in Arrow batches."""
    lists = small.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chain", "is_link"))).alias("c"))
    kind = small.schema["query_id"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for q, rows in zip(frame["query_id"], frame["c"]):
                chains = [list(r["chain"]) for r in rows]
                links = [tuple(r["chain"]) for r in rows if r["is_link"]]
                out += [(q, c) for c in joined(chains, links, most)]
            yield pd.DataFrame(out, columns=["query_id", "chain"])

    return lists.mapInPandas(run, f"query_id {kind}, chain array<string>")


def chain_table(paths: DataFrame, nodes: DataFrame, links: DataFrame, most: int = MAX_CHAINS) -> DataFrame:
    """``query_id, rank, chain`` for every query: all cited paths and links, lengthened by links
    where there are fewer than ``most`` of them, without repeats and stretches; by the best
    score on a chain, then length, both falling, then ids.

    Only queries with fewer than ``most`` chains are ever gathered in a row, so that row is
    bounded; everything else is joins and aggregates on (query, document) and (query, chain).
    """
    found = cited(paths, nodes).select("query_id", F.struct(F.lit(0).alias("l"), "hops", "place").alias("seq"), "chain", F.lit(False).alias("is_link"))
    of_links = cited_links(links, nodes).select("query_id", F.struct(F.lit(1).alias("l"), F.lit(0).alias("hops"), F.array("src", "dst", "kind").alias("place")).alias("seq"), F.array("src", "dst").alias("chain"), F.lit(True).alias("is_link"))
    every = settled(found.unionByName(of_links))  # read four times below
    counts = every.groupBy("query_id").agg(F.count("*").alias("n"), F.max("is_link").alias("any")).where((F.col("n") < most) & F.col("any"))
    few = counts.select("query_id")
    grown = _lengthened(every.join(few, "query_id", "left_semi"), most)
    kept = reduced(every.select("query_id", "chain").unionByName(grown))
    each = kept.select("query_id", "chain", F.explode("chain").alias("node")).join(nodes.select("query_id", "node", "score"), ["query_id", "node"])
    scored = each.groupBy("query_id", "chain").agg(F.max("score").alias("best"))
    return rank.numbered(scored, [F.desc("best"), F.desc(F.size("chain")), F.asc("chain")], ("query_id",)).select("query_id", "rank", "chain")


def gaps(nodes: DataFrame, chains: DataFrame, any_edge: bool = True) -> DataFrame:
    """``query_id, position, message``: seeds and blamed commits on no chain, in rank order; one
    line for a query if the index has no edges at all."""
    linked = chains.select("query_id", F.explode("chain").alias("node")).distinct()
    alone = nodes.where(F.col("role").isin("seed", "blamed_commit")).join(linked, ["query_id", "node"], "left_anti")
    if not any_edge:
        return alone.select("query_id").distinct().select("query_id", F.lit(1).cast("bigint").alias("position"), F.lit(UNLINKED).alias("message"))
    message = F.concat("title", F.lit(" ("), "node", F.lit(f") {ALONE}"))
    return rank.numbered(alone.select("query_id", "rank", message.alias("message")), [F.asc("rank")], ("query_id",), "position").select("query_id", "position", "message")
