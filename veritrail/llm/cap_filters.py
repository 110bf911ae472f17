"""Links between near vectors by spherical-cap filters of a random product code."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

THRESHOLD = 0.95
#: Independent product codes; several even out how many filters a vector is in.
CODES = 4
#: Filters that two vectors at the threshold share on average, by the normal approximation.
SHARED = 16
#: Random vectors in a filter, on average. The number of filters grows with the table, so that
#: buckets do not fill up and pairs that meet by chance grow with the rows alone.
FULL = 0.25
#: Codewords of a block at most; where more filters are wanted, codes get another block.
WORDS = 4096
#: A bucket of more rows is compared in blocks of this size, each pair of blocks by itself.
BLOCK = 2048
#: Groups up to this size are compared across groups at once.
SMALL = 16


@dataclass(frozen=True)
class Shape:
    """Blocks of a code, codewords of a block, and filters of a code that a vector is in: on
    average, and at least."""

    blocks: int
    words: int
    each: int
    least: int


def shape_for(n: int) -> Shape:
    """For a table of n vectors: as many filters as FULL asks for, and a vector in as many as
    SHARED asks for, which more and narrower filters make more."""
    each = 4
    for _ in range(8):
        filters = max(n * each / FULL, 1 << 14)
        each = math.ceil(SHARED / CODES / _again(min(0.25, each / filters)))
    blocks = 2
    while filters ** (1 / blocks) > WORDS:
        blocks += 1
    return Shape(blocks, math.ceil(filters ** (1 / blocks)), each, math.ceil(0.75 * each))


def _again(share: float) -> float:
    """How likely a vector at the threshold from one that is in a filter, as a share of random
    vectors is, is in it too: of two normal numbers, correlated so, past the same cut."""
    normal, steps = NormalDist(), 200
    cut = normal.inv_cdf(1 - share)
    xs = [cut + 4 * (k + 0.5) / steps for k in range(steps)]
    both = sum(normal.pdf(x) * normal.cdf((THRESHOLD * x - cut) / math.sqrt(1 - THRESHOLD**2)) for x in xs)
    return both / sum(normal.pdf(x) for x in xs)


class Code:
    """A random product code: a rotation, unit codewords for each block of coordinates, and the
    inner product from which a vector belongs to a filter, a sum of one codeword a block."""

    def __init__(self, width: int, shape: Shape, seed: int):
        rng = np.random.default_rng([width, shape.blocks, shape.words, seed])
        blocks = max(1, min(shape.blocks, width // 2))
        words = math.ceil(shape.words ** (shape.blocks / blocks))
        self.each, self.least = shape.each, shape.least
        self.rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        self.parts = np.array_split(np.arange(width), blocks)
        self.words = []
        for part in self.parts:
            w = rng.normal(size=(min(words, WORDS), len(part))) if len(part) > 1 else np.array([[1.0], [-1.0]])
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        self.filters = math.prod(map(len, self.words))
        self.cut = self._calibrated(rng.normal(size=(256, width)))

    def _calibrated(self, probe: np.ndarray) -> float:
        """The cut that random vectors pass ``each`` times on average."""
        products = self._products(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        share = min(0.5, self.each / self.filters)
        high = math.sqrt(len(self.parts) / probe.shape[1]) * NormalDist().inv_cdf(1 - share)
        step, often = high / 50, lambda cut: len(self._exceeding(products, cut)[0]) / len(probe)
        while often(high) > self.each:
            high += step
        while step > 1e-9 and often(high - step) < self.each and high > 0:
            high -= step
        low = high - step
        for _ in range(6):
            middle = (low + high) / 2
            low, high = (middle, high) if often(middle) > self.each else (low, middle)
        return high

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        turned = x @ self.rotation
        return [turned[:, part] @ words.T for part, words in zip(self.parts, self.words)]

    @staticmethod
    def _exceeding(products: list[np.ndarray], cut: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` for every filter that a row exceeds, by rows: partial sums that
        can't pass with the best codewords of the blocks to come are left out."""
        best = np.stack([p.max(axis=1) for p in products])
        total, rest = best.sum(axis=0), best.sum(axis=0)
        rows, sums, ids = np.arange(len(total)), np.zeros(len(total)), np.zeros(len(total), dtype=np.int64)
        for p, b in zip(products, best):
            rest = rest - b
            of, word = np.nonzero(p >= (cut - (total - b))[:, None])
            n = np.bincount(of, minlength=len(total))
            first, times = np.cumsum(n) - n, n[rows]
            at = np.repeat(np.arange(len(rows)), times)
            j = word[np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[rows[at]]]
            sums = sums[at] + p[rows[at], j]
            keep = sums + rest[rows[at]] >= cut
            rows, sums, ids = rows[at][keep], sums[keep], (ids[at] * p.shape[1] + j)[keep]
        return rows, ids

    @staticmethod
    def _best(products: list[np.ndarray], n: int) -> np.ndarray:
        """The n filters of each row with the largest inner products."""
        sums, ids = np.zeros((len(products[0]), 1)), np.zeros((len(products[0]), 1), dtype=np.int64)
        for p in products:
            some = min(n, p.shape[1])
            top = np.argpartition(-p, some - 1, axis=1)[:, :some]
            sums = (sums[:, :, None] + np.take_along_axis(p, top, axis=1)[:, None]).reshape(len(p), -1)
            ids = (ids[:, :, None] * p.shape[1] + top[:, None]).reshape(len(p), -1)
            some = min(n, sums.shape[1])
            at = np.argpartition(-sums, some - 1, axis=1)[:, :some]
            sums, ids = np.take_along_axis(sums, at, axis=1), np.take_along_axis(ids, at, axis=1)
        return ids

    def filters_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)``: all filters that a row exceeds, and its ``least`` best if they are fewer."""
        products = self._products(x)
        rows, ids = self._exceeding(products, self.cut)
        few = np.flatnonzero(np.bincount(rows, minlength=len(x)) < self.least)
        if len(few):
            more = self._best([p[few] for p in products], self.least)
            keep = ~np.isin(rows, few)
            rows = np.concatenate([rows[keep], np.repeat(few, more.shape[1])])
            ids = np.concatenate([ids[keep], more.ravel()])
        return rows, ids


@functools.lru_cache(maxsize=8)
def product_codes(width: int, shape: Shape) -> list[Code]:
    return [Code(width, shape, k) for k in range(CODES)]


def decode(x: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """For each unit vector the filters it belongs to, sorted."""
    rows, ids, first = [], [], 0
    for code in product_codes(x.shape[1], shape):
        r, f = code.filters_of(x)
        rows.append(r)
        ids.append(f + first)
        first += code.filters
    rows, ids = np.concatenate(rows), np.concatenate(ids)
    order = np.lexsort((ids, rows))
    return np.split(ids[order], np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _spread(shape: Shape):
    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")])
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                for at in range(0, part.num_rows, 256):
                    rows = part.slice(at, 256)
                    x = _vectors(rows.column("v"))
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    lists = decode(x / np.linalg.norm(x, axis=1, keepdims=True), shape)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*rows.schema.names, "own"])

    return run


class _Links:
    """What a task has found: for each vector the copies linked to it, and a tree of links."""

    def __init__(self):
        self.rows: list[tuple[bytes, bytes, int]] = []

    def add(self, cids, n, i: np.ndarray, j: np.ndarray) -> None:
        """Links between rows i and j: each vector's number of linked rows, and an edge to the
        least vector of what is connected here."""
        parent: dict[bytes, bytes] = {}

        def top(k):
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        weight: dict[bytes, int] = {}
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = cids[p].as_py(), cids[q].as_py()
            weight[a] = weight.get(a, 0) + n[q]
            weight[b] = weight.get(b, 0) + n[p]
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        self.rows += [(k, top(k), int(w)) for k, w in weight.items()]

    def batch(self):
        columns = [*zip(*self.rows)] or [(), (), ()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["cid", "root", "linked"])


class _Own:
    """The filters of each row, sorted, without a Python object for each."""

    def __init__(self, column):
        self.flat = column.flatten().to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))

    def __getitem__(self, row: int) -> np.ndarray:
        return self.flat[self.ends[row - 1] if row else 0 : self.ends[row]]

    def met_before(self, i: int, j: int, here: int) -> bool:
        """Whether rows i and j share a filter before ``here``, where they count already."""
        a, b = self[i], self[j]
        return bool(np.isin(a[: np.searchsorted(a, here)], b[: np.searchsorted(b, here)]).any())


def _first_shared(own: _Own, i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the least filter that rows i and j share, for many pairs of a group."""
    sets = {k: own[k][: np.searchsorted(own[k], here)] for k in {*i.tolist(), *j.tolist()}}
    all_ = np.unique(np.concatenate([*sets.values()])) if sets else np.empty(0)
    if not len(all_):
        return np.ones(len(i), dtype=bool)
    keys = np.array(sorted(sets))
    grid = np.zeros((len(keys), len(all_)), dtype=bool)
    for p, k in enumerate(keys.tolist()):
        grid[p, np.searchsorted(all_, sets[k])] = True
    grid = np.packbits(grid, axis=1)
    a, b, out = np.searchsorted(keys, i), np.searchsorted(keys, j), np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 4096):
        out[at : at + 4096] = ~(grid[a[at : at + 4096]] & grid[b[at : at + 4096]]).any(axis=1)
    return out


def _pairs_within(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of rows of one group, for many groups at once."""
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.empty(0, dtype=np.int64)
    n = np.repeat(ends, ends - starts) - rows - 1
    i = np.repeat(rows, n)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _verify(threshold: float):
    columns = ["width", "filter", "low", "high", "cid", "n", "v", "own", "block"]

    def small(links, here, cids, n, x, own, starts, ends):
        """Pairs of many small groups in one go; few pass, and only they are looked at further."""
        i, j = _pairs_within(starts, ends)
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            kept = [(a, b) for a, b in zip(p[near].tolist(), q[near].tolist()) if not own.met_before(a, b, here[a])]
            if kept:
                links.add(cids, n, *np.array(kept).T)

    def large(links, key, cids, n, x, own, rows, side):
        """Compares all pairs of a group, or, of two blocks, those across."""
        here, low, high = key
        left, right = (rows, rows) if low == high else (rows[side[rows] == low], rows[side[rows] == high])
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            i, j = np.nonzero(x[part] @ x[right].T >= threshold)
            i, j = part[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            if len(i):
                keep = _first_shared(own, i, j, here)
                links.add(cids, n, i[keep], j[keep])

    def flush(links, table):
        """All groups of a table whose rows are sorted by group, of one width at a time."""
        keys = np.stack([table.column(c).to_numpy() for c in columns[:4]], axis=1)
        for width in np.unique(keys[:, 0]):
            first, last = np.searchsorted(keys[:, 0], width), np.searchsorted(keys[:, 0], width, side="right")
            part, of = table.slice(first, last - first).combine_chunks(), keys[first:last]
            x = _vectors(part.column("v").chunk(0))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            cids, n, own, side = part.column("cid").chunk(0), part.column("n").to_numpy(), _Own(part.column("own").chunk(0)), part.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]).any(axis=1))))
            ends = np.append(starts[1:], len(of))
            few = (ends - starts <= SMALL) & (of[starts, 2] == of[starts, 3])
            small(links, of[:, 1], cids, n, x, own, starts[few], ends[few])
            for a, b in zip(starts[~few], ends[~few]):
                large(links, of[a, 1:].tolist(), cids, n, x, own, np.arange(a, b), side)

    def run(batches):
        links, held = _Links(), []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch.select(columns)])
            last = [table.column(c)[table.num_rows - 1].as_py() for c in columns[:4]] if table.num_rows else None
            same = np.all([table.column(c).to_numpy() == k for c, k in zip(columns, last)], axis=0) if last else ()
            cut_at = int(np.argmax(same)) if len(same) else 0
            if cut_at:
                flush(links, table.slice(0, cut_at))
            held = table.slice(cut_at).to_batches()
            yield links.batch()
        if held:
            flush(links, pa.Table.from_batches(held))
        yield links.batch()

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Rows with equal vectors are one class, counted and not paired. Each class goes to all
    filters of the product codes that it exceeds; rows that meet in a filter are compared in
    double precision, and a pair counts in the least filter it shares. The number of filters
    follows from the number of classes, so a filter holds about a quarter of a random vector
    at any size, and vectors are sent only to filters that several classes share; the number
    of filters a vector is in grows slowly with it, so that recall doesn't fall. A bucket too large for one task is cut into blocks whose pairs are tasks of their
    own. Tasks return, for each vector, a number of links and one edge, so output is linear
    in the rows compared.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing; so do vectors of different widths. Repeated ids are separate rows. A null id
    is never the least of a component unless all are null. An empty table gives an empty
    result. Only the two named columns are read, whatever else the table has.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    keyed = rows.select("vec_id", "v", F.when(usable, F.unhex(F.md5(F.col("v").cast("string").cast("binary")))).alias("cid"))
    classes = cut(keyed.where("cid is not null").groupBy("cid").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    value = vectors.schema[vec_col].dataType.simpleString()
    shape = shape_for(classes.count())
    filtered = cut(classes.select("cid", "n", "v").mapInArrow(_spread(shape), f"cid binary, n bigint, v {value}, own array<bigint>"))
    light = filtered.select("cid", F.size("v").alias("width"), F.explode("own").alias("filter"))
    sizes = light.groupBy("width", "filter").agg(F.count("*").alias("size")).where("size > 1")
    met = light.join(sizes, ["width", "filter"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.hash("cid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    key = ["width", "filter", "low", "high"]
    met = met.join(filtered, "cid").select(*key, "cid", "n", "v", "own", "block").repartition(*key).sortWithinPartitions(*key)
    found = met.mapInArrow(_verify(threshold), "cid binary, root binary, linked bigint")
    found = cut(found.groupBy("cid", "root").agg(F.sum("linked").alias("linked")))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    joined = classes.select("cid", "least").join(roots.withColumnRenamed("node", "cid"), "cid")
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    of_class = (
        classes.select("cid", "n", "least")
        .join(linked, "cid", "left")
        .join(joined.join(least, "root").select("cid", "component"), "cid", "left")
        .select("cid", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    )
    whole = keyed.select("vec_id", "cid").join(of_class, "cid", "left")
    component = F.coalesce("component", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
