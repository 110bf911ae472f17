"""Packing of token sequences: linear grouping, configurations, best fit for the rest."""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_trie import byte_characters
from .common import cut, slices

CAPACITY, END_ID = 2048, 0
#: Configurations that are tried, as the share of the capacity over which a length counts
#: as large, and the number of groups; the plan with the fewest sequences is taken.
TRIES = ((1 / 4, 12), (1 / 3, 8), (1 / 3, 12), (2 / 5, 12), (1 / 2, 12))
#: The pattern that cuts a text before the merges of a byte-level vocabulary (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The vocabulary of ``path`` in the faster of two libraries."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in byte_characters().items()}
    ranks = {bytes([byte[c] for c in token]): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in set(special.values())}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def _plain(path: str):
    """The tokenizer of ``path`` itself; loaded only where the other gives up."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def token_ids(text: str, path: str) -> np.ndarray:
    try:
        return np.array(_fast(path).encode(text, allowed_special="all"), dtype="<u4")
    except (ValueError, RuntimeError):  # the pattern engine gives up on extreme runs
        return np.array(_plain(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens; the first takes what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class Plan:
    """Which ranks of which lengths go where, as runs, so that its size depends on the
    number of distinct lengths and patterns, not on the number of documents.

    A class is ``[number of bins, free, items]``, an item ``(length, first rank, pieces in
    a bin, offset)``; bin k of the class holds ranks first + k * pieces and on.
    """

    def __init__(self, counts: dict[int, int], large: float, groups: int, capacity: int = CAPACITY):
        self.capacity, self.large, self.left = capacity, large, {k: v for k, v in counts.items() if v}
        self.rank = dict.fromkeys(self.left, 0)
        self.classes: dict[int, list] = {}
        self.frees: list[int] = []
        self._configured(groups)
        self._best_fit()

    def _put(self, bins: int, free: int, items: list) -> None:
        if free not in self.classes:
            self.classes[free] = []
        if not self.classes[free]:
            at = bisect_left(self.frees, free)
            if at == len(self.frees) or self.frees[at] != free:
                self.frees.insert(at, free)
        self.classes[free].append([bins, items])

    def _take(self, length: int, n: int) -> int:
        first = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        return first

    def _configured(self, groups: int) -> None:
        large = [(s, self.left[s]) for s in sorted(self.left, reverse=True) if s > self.capacity * self.large]
        total = sum(n for _, n in large)
        if not total:
            return
        each, sizes = -(-total // groups), []
        members: list[list[list[int]]] = []
        room = 0
        for s, n in large:  # groups of equal cardinality, each rounded up to its largest
            while n:
                if not room:
                    if not sizes or sizes[-1] != s:
                        sizes.append(s)
                        members.append([])
                    room = each
                k = min(n, room)
                if members[-1] and members[-1][-1][0] == s:
                    members[-1][-1][1] += k
                else:
                    members[-1].append([s, k])
                n, room = n - k, room - k
        demand = [sum(k for _, k in m) for m in members]
        for pattern, times in configurations(sizes, demand, self.capacity):
            slots = [g for g, k in enumerate(pattern) for _ in range(k)]
            while times:  # actual documents take the slots of their group; runs of equal bins
                use: dict[tuple[int, int], int] = {}
                heads = []
                for g in slots:
                    heads.append(members[g][0][0])
                    use[g, heads[-1]] = use.get((g, heads[-1]), 0) + 1
                run = min(times, *(members[g][0][1] // k for (g, _), k in use.items()))
                if not run:  # one bin whose slots of a group cross to the next length
                    heads = []
                    for g in slots:
                        heads.append(members[g][0][0])
                        members[g][0][1] -= 1
                        if not members[g][0][1]:
                            members[g].pop(0)
                    run = 1
                else:
                    for (g, _), k in use.items():
                        members[g][0][1] -= run * k
                        if not members[g][0][1]:
                            members[g].pop(0)
                times -= run
                items, at = [], 0
                for s in sorted(set(heads), reverse=True):
                    k = heads.count(s)
                    items.append((s, self._take(s, run * k), k, at))
                    at += s * k
                self._put(run, self.capacity - at, items)

    def _best_fit(self) -> None:
        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                at = bisect_left(self.frees, s)
                if at == len(self.frees):
                    k = self.capacity // s
                    bins, k = (n // k, k) if n >= k else (1, n)
                    self._put(bins, self.capacity - k * s, [(s, self._take(s, bins * k), k, 0)])
                    n -= bins * k
                    continue
                free = self.frees[at]
                bins, items = self.classes[free].pop()
                if not self.classes[free]:
                    self.frees.pop(at)
                k = free // s
                full, k = (min(bins, n // k), k) if n >= k else (1, n)
                first = self._take(s, full * k)
                n -= full * k
                if full < bins:
                    self._put(bins - full, free, [(a, r + full * p, p, o) for a, r, p, o in items])
                self._put(full, free - k * s, [*items, (s, first, k, self.capacity - free)])

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """``(length, first rank, rank after the last, pieces in a bin, first sequence, offset)``."""
        out, base = [], 0
        for free in sorted(self.classes):
            for bins, items in self.classes[free]:
                out += [(s, r, r + bins * p, p, base, o) for s, r, p, o in items]
                base += bins
        self.sequences = base
        return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of ``sizes`` and how often each is used, by column generation: patterns are
    priced by an integer knapsack over the capacity; whole parts of the solution are taken,
    so no demand is exceeded and at most one bin a size is left over."""
    k, s = len(sizes), np.array(sizes)
    order = np.argsort(s)
    basis = np.diag([float(capacity // x) for x in sizes])
    cost = np.ones(k)
    b = np.array(demand, dtype=float)
    for _ in range(40 * k):
        dual = np.linalg.solve(basis.T, cost)
        if dual.min() < -1e-9:
            column, price = np.zeros(k), 0.0
            column[dual.argmin()] = -1
        else:
            pattern, value = _knapsack(s[order], dual[order], capacity)
            if value <= 1 + 1e-7:
                break
            column, price = np.zeros(k), 1.0
            column[order] = pattern
        x, d = np.linalg.solve(basis, np.stack([b, column], axis=1)).T
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if ratio[out] == np.inf:
            break
        basis[:, out], cost[out] = column, price
    x = np.linalg.solve(basis, b)
    left, found = list(demand), []
    for j in range(k):
        if cost[j]:
            pattern = [int(v) for v in basis[:, j].round()]
            times = min([int(x[j] + 1e-6), *(left[g] // a for g, a in enumerate(pattern) if a)])
            if times > 0:
                left = [n - a * times for n, a in zip(left, pattern)]
                found.append((pattern, times))
    return found


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fits[c]
        value = best[c - sizes[:n]] + values[:n]
        at = int(value.argmax())
        if value[at] > best[c - 1]:
            best[c], pick[c] = value[at], at
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        pattern[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return pattern, float(best[capacity])


def best_plan(counts: dict[int, int], capacity: int = CAPACITY):
    plans = [(p.rows(), p.sequences) for p in (Plan(counts, *t, capacity) for t in TRIES)]
    return min(plans, key=lambda x: x[1])


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each row: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(token_ids(text or "", vocabulary), np.array(END_ID, dtype="<u4"))
                for i, (start, n) in enumerate(cuts(len(ids), capacity)):
                    out.append((doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = [*zip(*out)] or [()] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Packs the token pieces of all rows into sequences of at most ``capacity`` tokens.

    Adds ``sequence_id, offset`` to what :func:`pieces` returns. Only rows of more than
    ``capacity`` tokens are cut. The plan is made from counts by length (at most
    ``capacity`` numbers, whatever the input) and handed back as rank ranges, some
    thousands of rows at most, so it may be broadcast. Ranks come from two levels, length
    and a hash bucket, so a length that a third of the rows share is spread. A null or
    empty text is the end id alone; repeated rows are packed each, rows without an id too; an
    empty table gives an empty result. Only the two named columns are read. A text's ids are
    held whole by the task that cuts them, four bytes each.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, vocabulary, id_col, text_col, capacity))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = best_plan(counts, capacity) if counts else ([], 0)
    plan = spark.createDataFrame(rows, "length bigint, lo bigint, hi bigint, per bigint, base bigint, at bigint")
    spread = max(16, sum(counts.values()) // 100_000)
    dealt = made.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "_deal").agg(F.count("*").alias("n")).select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "_deal").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "_deal"]).withColumn("rank", F.col("rank") + F.col("first"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo and rank < hi")
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(k / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"),
    )
