"""Spelling variants: one-edit pairs of a corpus's words by merging subtrees of errata tries."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A code point is deleted where the checksum of an occurrence is a multiple of this.
EVERY = 97
LENGTH, OFTEN = 5, 3
#: Words of a bucket above which its range of places is halved.
FULL = 20_000
#: Rows of buckets that a task takes, about.
ROWS = 50_000
#: Letters that a task puts into one trie, about.
LETTERS = 150_000


def words_of(documents: DataFrame) -> DataFrame:
    """``word, n``: how often each word occurs in all texts, one letter of some occurrences deleted."""
    run = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    plain = F.length("run") == F.octet_length("run")  # translate is slow and letters beyond ASCII are rare
    run = run.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    run = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return run.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _buckets(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``: words of one have the letters before ``low`` and those after ``high`` in common."""
    after = F.greatest(F.col("m") - F.col("high"), F.lit(0))
    tail = F.substr("word", F.length("word") - after + 1, after)
    return rows.withColumn("after", after).withColumn("bucket", F.xxhash64("m", "low", "high", F.substr("word", F.lit(1), F.col("low")), tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's range of places in two."""
    middle = ((F.col("low") + F.col("high")) / 2).cast("int")
    ranges = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "m", F.explode(ranges).alias("r")).select("word", "n", "m", "r.low", "r.high")


def dealt(words: DataFrame, full: int = FULL) -> DataFrame:
    """``word, n, m, low, high, after, bucket``: every two words that are one edit apart, the shorter of
    them m letters long, share exactly one bucket whose range holds the place of their first
    difference. A pair that differs at place p shares the letters before p and m - p - 1 letters at the end,
    so halving the range of p doubles what a bucket's words share; buckets of more than ``full``
    words are halved until they fit or are one place wide, when they hold what two letters can
    make at most."""
    lengths = F.array(F.length("word") - 1, F.length("word"))
    rows = words.select("word", "n", F.explode(lengths).alias("m")).where(f"m >= {LENGTH}").withColumn("low", F.lit(0)).withColumn("high", F.col("m") + 1)
    done, rows = None, _buckets(_halves(rows))
    while True:
        numbers = (F.count("*").alias("size"), F.max(F.col("high") - F.col("low")).alias("wide"), F.min(F.length("word") - F.col("m")).alias("longer"))
        size = rows.groupBy("bucket").agg(*numbers).where("size > 1 and longer = 0").drop("longer")
        sized = cut(rows.join(size, "bucket"))
        small = sized.where(f"size <= {full} or wide = 1").drop("size", "wide")
        done = small if done is None else done.unionByName(small)
        rows = sized.where(f"size > {full} and wide > 1").select("word", "n", "m", "low", "high")
        if rows.isEmpty():
            return done
        rows = _buckets(_halves(rows))


class Trie:
    """A trie of strings as parallel lists: each node's children by letter and the string that ends there."""

    def __init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list = [None]

    def add(self, text, item) -> None:
        children, node = self.children, 0
        for letter in text:
            below = children[node].get(letter)
            if below is None:
                below = children[node][letter] = len(children)
                children.append({})
                self.ends.append(None)
            node = below
        if self.ends[node] is None:
            self.ends[node] = []
        self.ends[node].append(item)

    def sizes(self) -> list[int]:
        """Nodes of each subtree; a child's number is always above its parent's."""
        size = [1] * len(self.children)
        for node in range(len(size) - 1, -1, -1):
            for below in self.children[node].values():
                size[node] += size[below]
        return size


def _graft(errata: Trie, source: Trie, root: int, letter: str) -> None:
    """Merges the subtree below ``root`` into ``errata``, its ends marked by the letter that was passed over."""
    stack = [(root, 0)]
    while stack:
        node, to = stack.pop()
        if source.ends[node]:
            if errata.ends[to] is None:
                errata.ends[to] = []
            errata.ends[to].append((letter, source.ends[node]))
        mine = errata.children[to]
        for c, below in source.children[node].items():
            at = mine.get(c)
            if at is None:
                at = mine[c] = len(errata.children)
                errata.children.append({})
                errata.ends.append(None)
            stack.append((below, at))


def _together(a: Trie, at: int, b: Trie, bt: int, first: str | None = None):
    """Pairs of ends at equal paths below two nodes, with the first letter of the path."""
    stack = [(at, bt, first)]
    while stack:
        x, y, f = stack.pop()
        if a.ends[x] and b.ends[y]:
            yield a.ends[x], b.ends[y], f
        left, right = a.children[x], b.children[y]
        for c in left if len(left) <= len(right) else right:
            if c in left and c in right:
                stack.append((left[c], right[c], f or c))


def one_edit(trie: Trie, start: int = 0):
    """Pairs of lists of items whose strings are one replaced or one skipped letter apart, each
    pair of strings once, found at the node where they part.

    At each node the largest child is heavy. The other, light subtrees are merged into an
    errata trie, their first letter passed over: coinciding ends differ in that letter (replaced), ends that coincide with the
    heavy child's likewise, and ends that coincide with the node's own are one letter longer
    (skipped). What the heavy child has one letter more than the node starts on another
    letter than the heavy one or is the node itself, so walking the light children beside the heavy one finds it. A letter is visited
    once for each light edge above it: O(n log n) in all. Nodes before ``start`` are passed by:
    with 1 the first letter, a bucket's number, has to be equal."""
    size = trie.sizes()
    for node in range(start, len(size)):
        children = trie.children[node]
        if not children:
            continue
        heavy = max(children, key=lambda c: (size[children[c]], c))
        top = children[heavy]
        if trie.ends[node] and trie.ends[top]:
            yield trie.ends[node], trie.ends[top]
        if len(children) == 1:
            continue
        errata = Trie()
        for c, below in children.items():
            if c == heavy:
                continue
            _graft(errata, trie, below, c)
            beside = trie.children[top].get(c)
            if beside is not None:  # heavy + c + rest against c + rest
                for a, b, _ in _together(trie, below, trie, beside, c):
                    yield a, b
        for marked in errata.ends:
            if marked and len(marked) > 1:
                for i, (_, a) in enumerate(marked):
                    for _, b in marked[:i]:
                        yield a, b
        for marked, b, _ in _together(errata, 0, trie, top):
            for _, a in marked:
                yield a, b
        for marked, b, f in _together(errata, 0, trie, node):
            for letter, a in marked:
                if letter != f:  # else the words part further down, where the same letter is passed over
                    yield a, b


def _parting(a: str, b: str) -> int:
    """Letters that two words have in common at the start."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


PAIRS = "word string, other string, n bigint"


def pairs(buckets: DataFrame) -> DataFrame:
    """``word, other, n``: both directions of all one-edit pairs, n the other's number. Buckets
    come sorted, and whole buckets go into tries of about LETTERS letters, each under a letter of its own."""

    def found(group):
        trie = Trie()
        for number, (shape, members) in enumerate(group):
            low, _, after, _ = shape
            for word, n in members:
                trie.add((number, *word[low : len(word) - after]), (word, n, shape))
        out = []
        for a, b in one_edit(trie, 1):
            for x, nx, (low, high, after, m) in a:
                for y, ny, _ in b:
                    same = x[len(x) - after :] == y[len(y) - after :]  # else only the bucket's hash is
                    if same and min(len(x), len(y)) == m and low <= _parting(x, y) < high:
                        out.append((x, y, ny))
                        out.append((y, x, nx))
        return out

    def run(batches):
        group, letters, bucket, members, shape = [], 0, None, [], None
        for batch in batches:
            for word, n, m, low, high, after, key in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, m, low, high) != bucket:
                    if len(members) > 1:
                        group.append((shape, members))
                    if letters > LETTERS:
                        yield from table(found(group))
                        group, letters = [], 0
                    bucket, members, shape = (key, m, low, high), [], (low, high, after, m)
                members.append((word, n))
                letters += len(word) - low - after
        if len(members) > 1:
            group.append((shape, members))
        yield from table(found(group))

    def table(rows):
        for at in range(0, len(rows), 10_000):
            parts = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.int64())], names=["word", "other", "n"])

    order = ["bucket", "m", "low", "high"]
    tasks = max(1, -(-buckets.count() // ROWS))
    return buckets.select("word", "n", "m", "low", "high", "after", "bucket").repartition(tasks, "bucket").sortWithinPartitions(*order).mapInArrow(run, PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form, n``. A form is at least twice as frequent as its word, so a chain
    has no more steps than n can double, and pointers that double reach its end in the logarithm of that."""
    most = forms.agg(F.max("n")).first()[0]
    steps = math.log2(max(most or 0, OFTEN) / OFTEN) + 1
    pointers = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        pointers = cut(pointers.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return pointers


def variants(documents: DataFrame, full: int = FULL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all texts that are long and frequent enough.

    A null text has no words, a null id counts as empty before the colon, and rows that repeat an id or
    a text count as often as they occur; very long texts and runs are read whole. Ties of n go to the smaller word in code-point order.
    Other columns are ignored. Words are counted in partial aggregates, so a frequent word or a hot
    source makes no large group; what follows grows with the number of different words.
    """
    spark = documents.sparkSession
    folder = new_folder(spark, "words")
    words_of(documents.select("doc_id", "text")).where(f"n >= {OFTEN}").write.parquet(folder)
    words = spark.read.schema("word string, n bigint").parquet(folder)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("other"))).alias("best")
    near = pairs(dealt(words, full)).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.n") >= 2 * F.col("n")
    rows = cut(
        joined.select(
            "word",
            F.when(is_form, F.col("best.other")).alias("form"),
            F.col("n"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form is not null").select("word", "form", F.col("form_n").alias("n")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
