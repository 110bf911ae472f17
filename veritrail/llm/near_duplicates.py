"""Near-duplicate documents by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, slices
from .components import connected_components
from .shingles import mixed, shingles

BINS, ROWS, PROBES = 128, 4, 2048
#: Buckets of at most this many classes are paired out; larger ones get stars.
SMALL = 8
#: Stars of a later round in a large bucket, and such rounds at most before the exact join.
CENTRES, ROUNDS = 4, 1
_EMPTY = np.uint64(2**64 - 1)
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_PROBE = np.random.default_rng(11).integers(0, BINS, (BINS, PROBES))
_MULTIPLY = np.random.default_rng(12).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BINS one-permutation minima of a sorted non-empty set. An empty bin takes the
    value of the first filled bin on its own fixed random probe sequence (densification
    whose variance is optimal); after PROBES misses, of the next filled bin."""
    at = np.searchsorted(hashes, _STARTS)
    values = hashes[np.minimum(at, len(hashes) - 1)]
    filled = (at < len(hashes)) & (values >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    empty = np.flatnonzero(~filled)
    if len(empty):
        hits = filled[_PROBE[empty]]
        first = hits.argmax(axis=1)
        donor = _PROBE[empty, first]
        lost = ~hits[np.arange(len(empty)), first]
        if lost.any():
            full = np.flatnonzero(filled)
            donor[lost] = full[np.searchsorted(full, empty[lost]) % len(full)]
        values = values.copy()
        values[empty] = values[donor]
    return values


def bands(hashes: np.ndarray) -> np.ndarray:
    """BINS / ROWS bucket numbers; the band's place is mixed in, so buckets of
    different bands don't meet."""
    rows = sketch(hashes).reshape(-1, ROWS) * _MULTIPLY
    return mixed(mixed(rows).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64)).view(np.int64)


def _signature(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sketches(batches):
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_signature(s) for s in sets], pa.binary()),
                pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                *batch.columns[2:],
            ],
            names=["doc_id", "n_shingles", "sig", "bands", *batch.schema.names[2:]],
        )


def _sets(batches):
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([_signature(s) for s in sets], pa.binary()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ],
            names=["sig", "items"],
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, sig, component_id, kept``.

    Documents are linked when their sets of 5-word shingles have a Jaccard similarity of
    at least ``percent`` / 100, confirmed on the full sets. Equal sets form one class and
    are never paired. Steps:

    1. one pass over the texts makes sketches; classes are aggregated before the shuffle;
    2. classes that share a bucket are paired: all of a bucket of at most SMALL, and of a
       larger one each with the bucket's centre alone (a star), so pairs are linear in the
       classes; all pairs whose sizes allow a link are confirmed on full sets, and
       components follow;
    3. large buckets that still hold several components get stars with other centres, for
       members outside the centre's component;
    4. what is left open in large buckets is joined exactly by the rarest shingles (prefix
       filter), so that a link which no centre has shown isn't lost.

    Null or wordless texts have an empty set and stand alone. ``component_id`` is the
    smallest id reachable; ids that are null stand alone unless linked. Rows that repeat
    an id with the same text are one class and are all kept or all dropped. An empty
    table gives an empty result; other columns of ``docs`` aren't looked at; a very long text is one
    row's sketch and, where it is confirmed, one set of shingles. With
    ``carried``, those columns of a row are returned too, and ``root``, which tells
    components apart where ids repeat or are null; it is null for an empty set.
    """
    spark_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    id_type = spark_docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("sig", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            *(spark_docs.schema[c] for c in carried),
        ]
    )
    rows = cut(spark_docs.mapInArrow(_sketches, schema))
    classes = cut(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    member = classes.select("sig", F.explode("bands").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(member.join(sizes, "bucket").join(classes.select("sig", "n"), "sig"))
    small, large = shared.where(F.col("size") <= SMALL), shared.where(F.col("size") > SMALL)
    centre = large.groupBy("bucket").agg(F.min(F.struct(*_MEMBER)).alias("c")).select("bucket", *(F.col(f"c.{c}").alias(f"{c}2") for c in _MEMBER))
    pairs = small.join(_second(small), "bucket").where("sig < sig2").union(large.join(centre, "bucket").where("sig <> sig2"))
    pairs = pairs.where(_sizes_allow(percent)).select(F.least("sig", "sig2").alias("sig"), F.greatest("sig", "sig2").alias("sig2"))
    pairs = cut(pairs.distinct())
    wanted = pairs.select("sig").union(pairs.select("sig2")).union(large.select("sig")).distinct()
    sets = cut(_full_sets(spark_docs, classes, wanted))
    roots = connected_components(cut(_confirmed(pairs, sets, percent)).toDF("u", "v"))
    for step in range(ROUNDS + 1):
        large = _open(large, roots)
        if not step:
            sets = cut(sets.join(large.select("sig").distinct(), "sig", "left_semi"))
        found = _more_stars(large, step * CENTRES, percent) if step < ROUNDS else _by_rarest(large, sets, percent)
        fresh = cut(found.join(pairs, ["sig", "sig2"], "left_anti"))
        links, pairs = cut(_confirmed(fresh, sets, percent)), pairs.union(fresh)
        if not links.isEmpty():
            roots = connected_components(roots.where("node <> root").union(links).toDF("u", "v"))
    joined = classes.select("sig", "rep").join(roots.withColumnRenamed("node", "sig"), "sig")
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    least = joined.join(least, "root").select("sig", "least", "root")
    known = classes.select("sig", "rep").join(least, "sig", "left").select("sig", F.coalesce("least", "rep").alias("least"), F.coalesce("root", "sig").alias("root"))
    return rows.select("doc_id", "n_shingles", "sig", *carried).join(known, "sig", "left").select(
        "doc_id",
        "n_shingles",
        "sig",
        F.coalesce("least", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("least", "doc_id")).alias("kept"),
        *((*carried, "root") if carried else ()),
    )


_MEMBER = ("sig", "n")


def _sizes_allow(percent: int):
    return (F.least("n", "n2") * 100) >= (F.greatest("n", "n2") * percent)


def _second(member: DataFrame) -> DataFrame:
    return member.select("bucket", *(F.col(c).alias(f"{c}2") for c in _MEMBER))


def _open(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of buckets that hold several components."""
    found = member.select("bucket", *_MEMBER).join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    several = found.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    return cut(found.join(several, "bucket"))


def _more_stars(member: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of each member with CENTRES centres of its bucket, chosen anew by a hash, outside
    the centre's component."""
    chosen = [F.min_by(F.struct(*_MEMBER, "root"), F.xxhash64("sig", "bucket", F.lit(seed + k))) for k in range(CENTRES)]
    centres = member.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("c"))
    each = member.join(centres, "bucket").withColumn("c", F.filter("c", lambda c: c["root"] != F.col("root"))).select(*_MEMBER, F.explode("c").alias("c"))
    each = each.select(*_MEMBER, *(F.col(f"c.{c}").alias(f"{c}2") for c in _MEMBER)).where(_sizes_allow(percent))
    return each.select(F.least("sig", "sig2").alias("sig"), F.greatest("sig", "sig2").alias("sig2")).distinct()


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the classes that may have to be confirmed, made again from one text of
    each; keeping every document's set instead would take more disk than the texts."""
    reps = classes.select("sig", "rep").join(wanted, "sig", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").select("text")
    made = texts.mapInArrow(_sets, "sig binary, items array<bigint>").where("sig is not null")
    return made.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("items").alias("items"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    other = sets.select(F.col("sig").alias("sig2"), F.col("items").alias("items2"))
    both = pairs.join(sets, "sig").join(other, "sig2")
    common = F.size(F.array_intersect("items", "items2"))
    return (
        both.select("sig", "sig2", common.alias("common"), (F.size("items") + F.size("items2")).alias("total"))
        .where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent)
        .select("sig", "sig2")
    )


def _by_rarest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles.

    Sets of size n that reach the threshold with another share one of any
    n - ceil(n * percent / 100) + 1 of their items, so long as all sets order items
    alike; rarest first, items that no other set here has use up places and pair nothing.
    """
    member = open_.select("sig", "n", "root").distinct()
    items = member.join(sets, "sig").select("sig", "n", "root", F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("df"), F.min("root").alias("a"), F.max("root").alias("b")).where("df > 1")
    held = items.join(common, "item")
    order = Window.partitionBy("sig")
    held = held.withColumn("own", F.count("*").over(order)).withColumn("place", F.row_number().over(order.orderBy("df", "item")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    held = held.where((F.col("place") + F.col("n") - F.col("own") <= prefix) & (F.col("a") != F.col("b")))
    held = held.withColumn("after", F.col("own") - F.col("place"))
    left = held.select("sig", "n", "root", "after", "item")
    right = held.select(*(F.col(c).alias(f"{c}2") for c in ("sig", "n", "root", "after")), "item")
    # at the first item that two sets share, what follows it in both must still be enough
    enough = (F.least("after", "after2") + 1) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    pairs = left.join(right, "item").where((F.col("root") != F.col("root2")) & (F.col("sig") < F.col("sig2")) & _sizes_allow(percent) & enough)
    return pairs.select("sig", "sig2").distinct()
