"""Product codes of vectors: integer Lloyd rounds with a lower bound for each group of entries."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, new_folder

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Groups that a codebook's entries are clustered into; a part carries one bound for each.
GROUPS = 6
#: Largest bound that is stored; a larger one may be lowered to it, which keeps it a bound.
MOST = 65535
#: Rows that are worked on at a time.
ROWS = 2048
#: Salts of the join with label sums, so that a label with a third of all rows is split.
SALTS = 32

STATE = "id bigint, label int, ints binary, codes binary, bounds binary"


@dataclass(frozen=True)
class Codebooks:
    """Integer entries ``(part, entry, position)``, the group of each entry ``(part, entry)``, and
    how far the entries of each group have moved at most since the bounds were taken."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floor of their parts' means; those without a part stay."""
        means = sums // np.maximum(counts, 1)[:, :, None]
        entries = np.where(counts[:, :, None] > 0, means, self.entries)
        far = root_above(((entries - self.entries) ** 2).sum(axis=2))
        drift = np.zeros((len(entries), GROUPS), dtype=np.int64)
        for g in range(GROUPS):
            drift[:, g] = np.where(self.groups == g, far, 0).max(axis=1, initial=0)
        return Codebooks(entries, self.groups, drift)


def root_below(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, exactly."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r = r - (r * r > squares)
    return r + ((r + 1) * (r + 1) <= squares)


def root_above(squares: np.ndarray) -> np.ndarray:
    r = root_below(squares)
    return r + (r * r < squares)


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry of a part's codebook: GROUPS centres picked farthest first, then
    five rounds of means. Any grouping gives the same codes; a good one skips more."""
    out = np.zeros(entries.shape[:2], dtype=np.int64)
    for p, book in enumerate(entries.astype(np.float64)):
        if not len(book):
            continue
        centres = book[:1]
        while len(centres) < min(GROUPS, len(book)):
            far = ((book[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, book[far.argmax()]])
        for _ in range(5):
            of = ((book[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([book[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(len(centres))])
        out[p] = ((book[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances ``(row, entry)`` of integers."""
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def assign(x: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None, books: Codebooks):
    """``(codes, bounds, squared distances, distances worked out)`` for rows ``x (row, part,
    position)``. A bound is at most the distance from a part to any entry of a group other than
    its own one, so a group is read only if its bound less the group's drift isn't above the exact
    distance to the present entry. All numbers are integers and an equal bound counts as failed,
    so ties are compared and go to the lower index."""
    n, parts, _ = x.shape
    new_codes = np.zeros((n, parts), dtype=np.uint8)
    new_bounds = np.zeros((n, parts, GROUPS), dtype=np.uint16)
    best = np.zeros((n, parts), dtype=np.int64)
    work = 0
    for p in range(parts):
        book, of = books.entries[p], books.groups[p]
        if codes is None:
            at, low = np.zeros(n, dtype=np.int64), np.zeros((n, GROUPS), dtype=np.int64)
        else:
            at = codes[:, p].astype(np.int64)
            low = np.maximum(bounds[:, p].astype(np.int64) - books.drift[p], 0)
        own = ((x[:, p] - book[at]) ** 2).sum(axis=1)
        work += n
        failed = low * low <= own[:, None]
        dist, to = own.copy(), at.copy()
        least = np.full((n, GROUPS), np.iinfo(np.int64).max)  # of the groups that are read
        second = least.copy()
        first = np.full((n, GROUPS), -1)
        for g in range(GROUPS):
            members = np.flatnonzero(of == g)
            rows = np.flatnonzero(failed[:, g]) if len(members) else []
            if not len(rows):
                continue
            d = squared(x[rows, p], book[members])
            work += d.size
            k = d.argmin(axis=1)
            here = np.arange(len(rows))
            least[rows, g], first[rows, g] = d[here, k], members[k]
            d[here, k] = np.iinfo(np.int64).max
            second[rows, g] = d.min(axis=1)
            better = (least[rows, g] < dist[rows]) | ((least[rows, g] == dist[rows]) & (first[rows, g] < to[rows]))
            dist[rows[better]], to[rows[better]] = least[rows[better], g], first[rows[better], g]
        for g in range(GROUPS):
            rest = np.where(first[:, g] == to, second[:, g], least[:, g])
            fresh = np.where(rest == np.iinfo(np.int64).max, MOST, np.minimum(root_below(np.minimum(rest, MOST * MOST)), MOST))
            left = (of[at] == g) & (to != at)  # a group that isn't read gets back the entry that a part leaves
            kept = np.where(left, np.minimum(low[:, g], root_below(own)), low[:, g])
            new_bounds[:, p, g] = np.where(failed[:, g], fresh, np.minimum(kept, MOST))
        new_codes[:, p], best[:, p] = to, dist
    return new_codes, new_bounds, best, work


def _limit(width: int) -> int:
    """Integers below it keep every sum of squares of a vector within 63 bits."""
    return int((2**63 / max(width, 1)) ** 0.5) // 2


def _vectors(column, width: int) -> np.ndarray:
    """Integers of a column of equal vectors, floor(SCALE * x)."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    ints = np.floor(flat * SCALE)
    if len(ints) and np.abs(ints).max() >= _limit(width):
        raise ValueError(f"a component is {SCALE} * {np.abs(flat).max():.6g}; squared errors of such vectors don't fit 64 bits")
    return ints.astype(np.int64).reshape(len(column), width)


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``id, label, vector`` of the rows with a vector whose components are all finite numbers."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.where(F.col(vector).isNotNull() & ~odd).select(F.col("vec_id").alias("id"), "label", x.alias("vector"))


def _padded(vectors: DataFrame, width: int) -> DataFrame:
    fill = F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size("vector"), F.lit(0)))
    return vectors.withColumn("vector", F.when(F.size("vector") < width, F.concat("vector", fill)).otherwise(F.col("vector")))


def first_codebooks(vectors: DataFrame, width: int, entries: int = ENTRIES) -> Codebooks:
    """Parts of the vectors of the smallest ids. A task sends on its own ``entries`` smallest at most."""

    def smallest(batches):
        held: dict[int, list[float]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.argsort(ids, kind="stable"):
                key, row = int(ids[i]), batch.column(1)[int(i)].as_py()
                if key in held:
                    held[key] = min(held[key], row)
                elif len(held) < entries or key < max(held):
                    held[key] = row
                    if len(held) > entries:
                        del held[max(held)]
                else:
                    break
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["id", "vector"])

    some = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(smallest, "id bigint, vector array<double>")
    rows = some.groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").limit(entries).collect()  # at most ``entries`` rows
    ints = _vectors(pa.array([r.vector for r in rows], pa.list_(pa.float64())), width)
    books = ints.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    return Codebooks(books, grouped(books), np.zeros((PARTS, GROUPS), dtype=np.int64))


def _step(books: Codebooks, width: int):
    """Batches ``(vector or ints, codes, bounds, ...)`` to the next state; first rounds have no codes."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                if "vector" in batch.schema.names:
                    x, codes, bounds = _vectors(batch.column("vector"), width), None, None
                else:
                    x = _fixed(batch.column("ints"), np.int32, n, width).astype(np.int64)
                    codes = _fixed(batch.column("codes"), np.uint8, n, PARTS)
                    bounds = _fixed(batch.column("bounds"), np.uint16, n, PARTS * GROUPS).reshape(n, PARTS, GROUPS)
                codes, bounds, best, _ = assign(x.reshape(n, PARTS, width // PARTS), codes, bounds, books)
                yield batch, x, codes, bounds, best

    return run


def _fixed(column, kind, n: int, width: int) -> np.ndarray:
    if not n or not width:
        return np.zeros((n, width), dtype=kind)
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=kind).reshape(n, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _round(rows: DataFrame, books: Codebooks, width: int, folder: str) -> DataFrame:
    """One assignment, written to ``folder`` with the vectors and their bounds."""
    step = _step(books, width)

    def run(batches):
        for batch, x, codes, bounds, _ in step(batches):
            parts = [batch.column("id"), batch.column("label"), _binary(x.astype(np.int32)), _binary(codes), _binary(bounds.reshape(len(x), -1))]
            yield pa.RecordBatch.from_arrays(parts, names=["id", "label", "ints", "codes", "bounds"])

    rows.mapInArrow(run, STATE).write.parquet(folder)
    return rows.sparkSession.read.schema(STATE).parquet(folder)


def _sums(state: DataFrame, width: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry: one row of a fixed size for each task."""
    each = width // PARTS

    def run(batches):
        sums, counts = np.zeros((PARTS, entries, each), dtype=np.int64), np.zeros((PARTS, entries), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            x = _fixed(batch.column("ints"), np.int32, n, width).reshape(n, PARTS, each).astype(np.int64)
            codes = _fixed(batch.column("codes"), np.uint8, n, PARTS)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()], pa.list_(pa.int64())) for a in (sums, counts)], names=["sums", "counts"])

    found = state.select("ints", "codes").mapInArrow(run, "sums array<bigint>, counts array<bigint>")
    one = found.select(F.lit(0).alias("of"), F.posexplode(F.concat("sums", "counts")).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(PARTS * entries * (each + 1), dtype=np.int64)
    for r in one.collect():  # a number for each component of the codebooks, whatever the table
        flat[r["at"]] = r["n"]
    return flat[: PARTS * entries * each].reshape(PARTS, entries, each), flat[PARTS * entries * each :].reshape(PARTS, entries)


def codes(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped. The width is
    that of the longest vector, rounded up to a multiple of PARTS; shorter ones count as followed by zeros.
    A null id gets a code, but doesn't start a codebook; of rows that repeat an id the smallest
    vector starts it, and all get codes. With fewer than ``entries`` ids a codebook is that much smaller; null labels
    are one label; other columns are ignored, whatever their names. A table without usable rows,
    or whose ids are all null, gives no rows. A component so large that an error wouldn't fit 64
    bits raises ValueError.

    Each round reads the state of the last from the shared folder (vector, codes, bounds), so a
    lost task repeats that round's share alone; a state is removed once the next is written.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-max(longest, 1) // PARTS) * PARTS
    vectors = _padded(vectors, width)
    books = first_codebooks(vectors, width, entries)
    if not books.entries.shape[1]:
        empty = spark.createDataFrame([], "code string, error bigint, label_error bigint, codebooks_sha256 string")
        return embeddings.select("vec_id").where("false").join(empty)
    state, before = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "vector"), None
    for _ in range(rounds):
        folder = new_folder(spark, "codes")
        state = _round(state, books, width, folder)
        dropped(spark, before)
        books, before = books.moved(*_sums(state, width, books.entries.shape[1])), folder
    step = _step(books, width)

    def last(batches):
        for batch, x, found, _, best in step(batches):
            text = pa.array([r.tobytes().hex() for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), text, pa.array(best.sum(axis=1), pa.int64())], names=["id", "label", "code", "error"])

    folder = new_folder(spark, "codes")
    schema = "id bigint, label int, code string, error bigint"
    state.mapInArrow(last, schema).write.parquet(folder)
    dropped(spark, before)
    coded = spark.read.schema(schema).parquet(folder)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("dealt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    rows = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt")))
    return rows.select(F.col("id").cast(embeddings.schema["vec_id"].dataType).alias("vec_id"), "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
