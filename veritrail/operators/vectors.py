"""Nearest neighbours by exact pruning: vectors stored in cells around centres."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TOP_K
from .search import KEY, Filters, knn, top

#: Vectors that the centres are made from, at most, and centres at most; every vector is stored.
SAMPLE, CELLS = 20_000, 1024
#: Rounds of means for the centres; others would prune less or more, never wrongly.
ROUNDS = 8
#: By how much a bound is loosened for the rounding of distances.
SLACK = 1e-9


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample by means, begun at evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        of = distances(sample, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = sample[of == c].mean(axis=0)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, without cancellation."""
    out = np.empty((len(x), len(y)))
    for j, row in enumerate(y):
        d = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


@dataclass(frozen=True)
class Cells:
    """Stored chunks with vectors, a folder for each cell, and the cells: centre, the largest distance of a
    vector in it to the centre, and how many there are."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    @staticmethod
    def write(chunks: DataFrame, folder: str, cells: int | None = None) -> Cells:
        """Deals the chunks that have a vector to the cell of the nearest centre."""
        spark, rows = chunks.sparkSession, chunks.where("embedding is not null")
        n = rows.count()
        picked = rows.select("embedding").where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
        sample = np.array([r.embedding for r in picked.limit(SAMPLE).collect()], dtype=np.float64)
        centres = centres_of(sample, cells or max(1, min(CELLS, int(n**0.5)))) if len(sample) else np.zeros((0, 0))

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                d = distances(x, centres)
                of = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(d[np.arange(len(d)), of], pa.float64())], names=[*batch.schema.names, "cell", "away"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, away double"
        if len(centres):
            # a cell may hold a third of all vectors; it is written by as many tasks as hold its rows
            rows.mapInArrow(run, schema).sortWithinPartitions("cell").write.partitionBy("cell").parquet(folder)
            found = {r.cell: r for r in spark.read.parquet(folder).groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()}  # a row a cell
        else:
            found = {}
        radius = np.array([found[c].away if c in found else 0.0 for c in range(len(centres))])
        size = np.array([found[c].n if c in found else 0 for c in range(len(centres))])
        return Cells(spark, folder, centres, radius, size)

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """What a vector of each cell is away from each query at least, by the triangle inequality."""
        return np.maximum(distances(asked, self.centres) - self.radius, 0.0) * (1 - SLACK) - SLACK

    def read(self, cells: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.folder).where(F.col("cell").isin(cells))

    def nearest(self, queries: DataFrame, k: int = TOP_K, where: Filters | None = None) -> tuple[DataFrame, float]:
        """The rows of :func:`veritrail.operators.search.knn`, and the share of stored vectors that weren't
        read. The cells with the least bounds that hold k vectors give each query a k-th distance
        among those that pass the filter; then the cells whose bound isn't above it are read. A
        query that found fewer than k there reads all cells."""
        asked = queries.select("query_id", "embedding").collect()
        live = np.flatnonzero(self.size)
        if not len(asked) or not len(live):
            return knn(self.spark.createDataFrame([], "doc_id string, ordinal int, embedding array<float>"), queries, k), 0.0
        x = np.array([r.embedding for r in asked], dtype=np.float64)
        if x.shape[1] != self.centres.shape[1]:
            raise ValueError("a query's width differs from the index's")
        low = self.bounds(x)
        begun: set[int] = set()
        for row in low:
            n = 0
            for c in sorted(live, key=lambda c: row[c]):
                begun.add(int(c))
                n += self.size[c]
                if n >= k:
                    break
        first = knn(self.read(sorted(begun)), queries, k, where, x.shape[1])
        worst = {r.query_id: -r.score for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}  # one a query
        left = {int(c) for r, row in zip(asked, low) for c in live if row[c] <= worst.get(r.query_id, np.inf)}
        wanted = sorted(left | begun)
        return knn(self.read(wanted), queries, k, where, x.shape[1]), 1.0 - self.size[wanted].sum() / self.size.sum()
