"""Lexical and vector search, fusion, and lifting of chunks to documents.

Every operator takes a table of queries and works on all of them at once; a single query is
a table of one row. Query tables are read to the driver for control (terms and vectors become
part of the plan), so they are meant to be small: thousands of queries, not millions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import BM25_B, BM25_K1, IDF_FLOOR, RRF_K, TABLES, TOP_K
from ..session import settled
from .store import Precondition, Tables

KEY = ["doc_id", "ordinal"]
#: Words that a task turns into postings at a time.
BATCH_WORDS = 200_000


@dataclass(frozen=True)
class Filters:
    """A conjunction over chunk attributes; None is no constraint; times are inclusive."""

    source: str | None = None
    repo_ref: str | None = None
    doc_type: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    doc_id: str | None = None

    def column(self) -> Column:
        tests = [(self.source, F.col("source") == self.source), (self.repo_ref, F.col("repo_ref") == self.repo_ref), (self.doc_type, F.col("doc_type") == self.doc_type), (self.doc_id, F.col("doc_id") == self.doc_id)]
        out = F.lit(True)
        for value, test in tests:
            if value is not None:
                out = out & test
        if self.since is not None:
            out = out & (F.col("created_at") >= F.lit(self.since))
        if self.until is not None:
            out = out & (F.col("created_at") <= F.lit(self.until))
        return out

    def within(self, since: datetime | None, until: datetime | None) -> Filters:
        """The overlap with another window; a missing bound never narrows."""
        later = [t for t in (self.since, since) if t is not None]
        earlier = [t for t in (self.until, until) if t is not None]
        return Filters(self.source, self.repo_ref, self.doc_type, max(later, default=None), min(earlier, default=None), self.doc_id)


#: What a posting keeps of its chunk, so that filters and lengths need no look at the chunk.
ATTRIBUTES = ["source", "repo_ref", "doc_type", "created_at"]


@dataclass(frozen=True)
class Index:
    """Chunks with their words, and what holds for the whole corpus whatever is filtered. ``stored``
    are the tables of an index that has been written, see :class:`StoredIndex`."""

    chunks: DataFrame
    n: int
    average: float
    stored: Tables | None = None
    #: The chunks without their vectors, where these come from a table of their own.
    bare: DataFrame | None = None

    @property
    def texts(self) -> DataFrame:
        return self.chunks if self.bare is None else self.bare

    def holding(self, terms: list[str]) -> DataFrame:
        """``term, doc_id, ordinal, tf, positions, dl`` and attributes of the postings of some
        words: read from their parts alone, or, of an index that isn't stored, made from one
        pass over the chunks that keeps those words only."""
        if self.stored is not None:
            return self.stored.of_keys("postings", terms)
        places = F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("position")))
        wanted = F.filter(places, lambda x: x["term"].isin(terms))
        each = self.chunks.select(*KEY, *ATTRIBUTES, "dl", F.explode(wanted).alias("x")).select("*", "x.term", "x.position")
        return _grouped(each)

    def frequencies(self, terms: list[str]) -> dict[str, int] | None:
        """In how many chunks each word is, by the stored counts; None if nothing is stored."""
        if self.stored is None:
            return None
        return {r.term: r.df for r in self.stored.of_keys("words", terms).collect()}


def _grouped(each: DataFrame) -> DataFrame:
    facts = [F.first(c).alias(c) for c in [*ATTRIBUTES, "dl"]]
    return each.groupBy("term", *KEY).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), *facts)


def index(chunks: DataFrame) -> Index:
    """Tokenises on the way; an index that is written (:class:`StoredIndex`) serves all later queries."""
    worded = chunks.withColumn("terms", X.tokens(F.col("text"))).withColumn("dl", F.size("terms"))
    stats = worded.agg(F.count("*").alias("n"), F.avg("dl").alias("average")).first()
    return Index(worded, stats.n, stats.average or 0.0)


def postings(chunks: DataFrame) -> DataFrame:
    """``term, doc_id, ordinal, tf, positions, dl`` and the chunk's attributes, of every word.
    Words are cut natively; those of a slice of a batch are then sorted by chunk, word and place as
    columns of numbers, so nothing is shuffled to bring the places of a word together."""
    rows = chunks.select(*KEY, *ATTRIBUTES, X.tokens(F.col("text")).alias("terms"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    facts = ", ".join(f"{c} {kinds[c]}" for c in ATTRIBUTES)
    return rows.mapInArrow(_posted, f"term string, doc_id {kinds['doc_id']}, ordinal {kinds['ordinal']}, tf bigint, positions array<int>, dl int, {facts}")


def _of_words(batches, most: int = BATCH_WORDS):
    """Arrow batches in slices of at most ``most`` words, or of one row, since the columns that are
    made of a slice take several numbers a word."""
    import numpy as np

    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _posted(batches):
    import numpy as np
    import pyarrow as pa

    for batch in _of_words(batches):
        lists = batch.column("terms")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        if not len(words):
            continue
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(row * len(words.dictionary) + word, kind="stable")  # places stay in order
        key = (row * len(words.dictionary) + word)[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(np.append(starts, len(key)))
        of = pa.array(row[order][starts])
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
        made = [words.dictionary.take(pa.array(word[order][starts])), batch.column("doc_id").take(of), batch.column("ordinal").take(of), pa.array(tf, pa.int64()), positions, pa.array(size[row[order][starts]], pa.int32())]
        yield pa.RecordBatch.from_arrays([*made, *(batch.column(c).take(of) for c in ATTRIBUTES)], names=["term", *KEY, "tf", "positions", "dl", *ATTRIBUTES])


@dataclass
class StoredIndex:
    """An inverted index in stored tables: ``postings`` dealt by word, ``words`` with the number of
    chunks of each, ``corpus`` with the number of chunks and their length, and the ``chunks``.

    An update replaces the chunks of some documents: their old postings are marked as removed
    under the words of the old text, new ones are added, and counts change by the difference, all in one
    transaction; nothing else is read or written. Old and new texts are cut into words once, into the segment that is
    written, and all counts are taken from that. A word with more postings than a part should
    hold is spread over all parts by its documents.
    """

    tables: Tables

    def update(self, chunks: DataFrame, touched: DataFrame) -> None:
        """``chunks`` are all chunks of the documents in ``touched`` (doc_id)."""
        tables = self.tables
        with tables.transaction():
            there = tables.state("chunks")[1]
            if not there and tables.state("postings")[1]:
                raise Precondition("the index was written without its texts, so what an update replaces isn't known")
            before = None
            if there:
                stored = tables.read("chunks", tables.touched("chunks", touched, "doc_id"))
                before = stored.join(touched.select("doc_id").distinct(), "doc_id", "left_semi")
            written = tables.add("chunks", chunks.select(*TABLES["chunks"].fieldNames()), touched if there else None).where("not _dead")
            old = postings(before).select(*(F.col(c) if c in _MARKED else F.lit(None).cast(TABLES["postings"][c].dataType).alias(c) for c in TABLES["postings"].fieldNames())) if there else None
            made = tables.add("postings", postings(written), replaced=old)
            sign = F.when(F.col("_dead"), -1).otherwise(1)
            tables.put("words", made.groupBy("term").agg(F.sum(sign).alias("df")).where("df <> 0"))
            corpus = _length(made, sign).unionByName(_chunks(written))
            tables.put("corpus", corpus.unionByName(_chunks(before, -1)) if there else corpus)
            for name in ("chunks", "postings"):
                tables.tidy(name)

    def index(self) -> Index:
        numbers = {r["name"]: r["value"] for r in self.tables.read("corpus").collect()}
        n = numbers.get("chunks", 0)
        return Index(self.tables.read("chunks"), n, numbers.get("length", 0) / n if n else 0.0, self.tables)


#: What a mark of a removed posting keeps: its unit, and what the counts need.
_MARKED = ("term", "doc_id", "ordinal", "tf")


def _length(made: DataFrame, sign: Column | int = 1) -> DataFrame:
    """The corpus's length as a row of ``corpus``: every word of a chunk is counted by one posting, so nothing is
    brought together by chunk. Postings lie by word, so each part has nearly all chunks."""
    return made.agg(F.coalesce(F.sum(F.col("tf") * sign), F.lit(0)).cast("bigint").alias("value")).select(F.lit("length").alias("name"), "value")


def _chunks(rows: DataFrame, sign: int = 1) -> DataFrame:
    return rows.agg((F.count("*") * sign).cast("bigint").alias("value")).select(F.lit("chunks").alias("name"), "value")


def write_index(chunks: DataFrame, folder: str, texts: DataFrame | None = None) -> Index:
    """An index of all chunks in a folder of its own. With ``texts``, the same chunks without their vectors, nothing but
    words is written: texts and vectors are read where they are, and such an index isn't updated but written anew."""
    tables = Tables(chunks.sparkSession, folder)
    stored = StoredIndex(tables)
    with tables.transaction():
        if texts is None:
            have = {c: F.col(c) for c in chunks.columns}
            tables.write("chunks", chunks.select(*(have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["chunks"].fields)))
        rows = tables.read("chunks") if texts is None else texts
        tables.write("postings", postings(rows))
        made = tables.read("postings")
        tables.write("words", made.groupBy("term").agg(F.count("*").alias("df")))
        tables.write("corpus", _length(made).unionByName(_chunks(rows)))
    return stored.index() if texts is None else replace(stored.index(), chunks=chunks, bare=texts)


def read_index(spark, folder: str) -> Index:
    return StoredIndex(Tables(spark, folder)).index()


def phrases(queries: DataFrame) -> DataFrame:
    """``query_id, qpos, phrase``: compounds are phrases, repeats stay, other marks are inert."""
    compounds = F.regexp_extract_all(X.folded(F.col("text")), F.lit(X.COMPOUND), F.lit(0))
    each = queries.select("query_id", F.posexplode(compounds).alias("qpos", "compound"))
    return each.select("query_id", "qpos", F.regexp_extract_all("compound", F.lit(X.TOKEN), F.lit(0)).alias("phrase"))


def frequencies(indexed: Index, wanted: list[tuple[str, ...]]) -> DataFrame:
    """``phrase, f, doc_id, ordinal, dl`` and attributes: how often each phrase (its place in
    ``wanted``) stands in each chunk that has it. Only postings of the phrases' words are
    read; those of a phrase are brought together by chunk, their places moved by the word's
    place in the phrase and intersected."""
    spark, facts = indexed.chunks.sparkSession, [*ATTRIBUTES, "dl"]
    words = [(i, k, len(p), t) for i, p in enumerate(wanted) for k, t in enumerate(p)]
    asked = F.broadcast(spark.createDataFrame(words, "phrase int, place int, words int, term string"))  # a query's words
    found = indexed.holding(sorted({w[3] for w in words})).join(asked, "term")
    single = found.where("words = 1").select("phrase", F.col("tf").alias("f"), *KEY, *facts)
    if all(len(p) == 1 for p in wanted):
        return single
    moved = found.where("words > 1").withColumn("at", F.transform("positions", lambda p: p - F.col("place")))
    met = moved.groupBy("phrase", "words", *KEY).agg(F.collect_list("at").alias("at"), *(F.first(c).alias(c) for c in facts)).where("size(at) = words")
    both = F.aggregate(F.slice("at", 2, F.size("at")), F.get("at", F.lit(0)), F.array_intersect)
    return single.unionByName(met.select("phrase", F.size(both).cast("bigint").alias("f"), *KEY, *facts).where("f > 0"))


def bm25(indexed: Index, queries: DataFrame, k: int = TOP_K, where: Filters | None = None) -> DataFrame:
    """``query_id, doc_id, ordinal, score, rank``: the best k chunks of each query.

    Document counts, lengths and frequencies are of the whole corpus; filters apply to the
    candidates only, before k. Of a stored index the words' numbers are read first, and only
    the postings that can matter are read whole, see :func:`_essential`.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = [(r.query_id, tuple(r.phrase)) for r in phrases(queries).collect()]
    distinct = sorted({p for _, p in asked})
    kind = queries.schema["query_id"].dataType.simpleString()
    empty = f"query_id {kind}, doc_id string, ordinal int, score double, rank bigint"
    if not distinct:
        return queries.sparkSession.createDataFrame([], empty)
    place = {p: i for i, p in enumerate(distinct)}
    times = queries.sparkSession.createDataFrame([(q, place[p]) for q, p in asked], f"query_id {kind}, phrase int")
    times = times.groupBy("query_id", "phrase").agg(F.count("*").alias("times"))
    stored = indexed.frequencies(sorted({p[0] for p in distinct if len(p) == 1})) if indexed.stored is not None else None
    if stored is None:
        found = settled(frequencies(indexed, distinct))
        df = found.groupBy("phrase").agg(F.count("*").alias("df"))
        return top(_totals(found, _weights(df, indexed, times), indexed, where), k)
    # a phrase's number of chunks is counted; a word's is stored
    phrased = [p for p in distinct if len(p) > 1]
    found = settled(frequencies(indexed, phrased).withColumn("phrase", _renumbered(phrased, place))) if phrased else None
    known = queries.sparkSession.createDataFrame([(place[p], stored[p[0]]) for p in distinct if len(p) == 1 and p[0] in stored], "phrase int, df bigint")
    df = known if found is None else known.unionByName(found.groupBy("phrase").agg(F.count("*").alias("df")))
    weights = _weights(df, indexed, times)
    return top(_essential(indexed, distinct, place, found, weights, where, k), k)


def _renumbered(some: list, place: dict) -> Column:
    return F.element_at(F.array(*(F.lit(place[p]) for p in some)), F.col("phrase") + 1)


def _weights(df: DataFrame, indexed: Index, times: DataFrame) -> DataFrame:
    """``query_id, phrase, idf, times``: a row for each phrase of the queries."""
    idf = F.greatest(F.log((F.lit(float(indexed.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    return df.withColumn("idf", idf).join(F.broadcast(times), "phrase").select("query_id", "phrase", "df", "idf", "times")


def _totals(found: DataFrame, weights: DataFrame, indexed: Index, where: Filters | None) -> DataFrame:
    weight = F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("dl") / F.lit(indexed.average)))
    # a row for each phrase of the queries, which the driver holds already
    scored = found.where((where or Filters()).column()).join(F.broadcast(weights.select("query_id", "phrase", "idf", "times")), "phrase")
    return scored.groupBy("query_id", *KEY).agg(_added(F.col("times") * F.col("idf") * weight).alias("score"))


def _added(parts: Column) -> Column:
    """The sum of what a query's phrases add, least first: the same to the last bit for chunks of the same
    numbers, in whatever order they come, so that copies of a text are ranked by their keys."""
    return F.aggregate(F.sort_array(F.collect_list(parts)), F.lit(0.0), lambda a, x: a + x)


def _essential(indexed: Index, distinct: list, place: dict, phrased: DataFrame | None, weights: DataFrame, where: Filters | None, k: int) -> DataFrame:
    """Scores of all chunks that can be among a query's best k, and no others' need be right.

    A word adds less than ``times * idf * (k1 + 1)`` to a score, however often it stands. The words of a
    query are taken by that bound, largest first; the k-th best score by the first ones that have k chunks is a
    floor for the answer's. Words at the end whose bounds together stay below the floor aren't essential: a chunk
    that holds none but those isn't among the best. So only chunks with an essential
    word are candidates, and the postings of the others, which are the longest lists, are joined
    with those alone, by chunk, and never grouped as a whole.
    """
    rows = weights.collect()  # a row for each phrase of each query
    kind = weights.schema["query_id"].dataType.simpleString()
    if not rows:
        return indexed.chunks.sparkSession.createDataFrame([], f"query_id {kind}, doc_id string, ordinal int, score double")
    weights = indexed.chunks.sparkSession.createDataFrame(rows, weights.schema)
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r.query_id, []).append((r.times * r.idf * (BM25_K1 + 1), r.phrase, r.df))
    for some in by_query.values():
        some.sort(key=lambda x: (-x[0], x[1]))
    words = {i: p for p, i in place.items()}
    spark = indexed.chunks.sparkSession

    def listed(numbers: set[int]) -> DataFrame:
        own = sorted(n for n in numbers if len(words[n]) == 1)
        rest = sorted(n for n in numbers if len(words[n]) > 1)
        out = None
        if own:
            single = frequencies(indexed, [words[n] for n in own])
            out = single.withColumn("phrase", F.element_at(F.array(*map(F.lit, own)), F.col("phrase") + 1))
        if rest:
            some = phrased.where(F.col("phrase").isin(rest))
            out = some if out is None else out.unionByName(some)
        return out

    first: dict = {}
    for q, some in by_query.items():
        n, chosen = 0, []
        for _, phrase, df in some:
            chosen.append(phrase)
            n += df
            if n >= k:
                break
        first[q] = chosen
    early = listed({p for some in first.values() for p in some})
    of_first = spark.createDataFrame([(q, p) for q, some in first.items() for p in some], f"query_id {kind}, phrase int")
    begun = top(_totals(early, weights.join(F.broadcast(of_first), ["query_id", "phrase"], "left_semi"), indexed, where), k)
    floors = {r.query_id: r.score for r in begun.where(F.col("rank") == k).select("query_id", "score").collect()}  # one a query
    needed: list[tuple] = []
    for q, some in by_query.items():
        rest, least = 0.0, len(some)
        while least and rest + some[least - 1][0] < floors.get(q, 0.0) * (1 - 1e-9):
            least -= 1
            rest += some[least][0]
        needed += [(q, phrase, i < least) for i, (_, phrase, _) in enumerate(some)]
    roles = spark.createDataFrame(needed, f"query_id {kind}, phrase int, essential boolean")
    main = {p for _, p, e in needed if e}
    weighed = weights.join(F.broadcast(roles), ["query_id", "phrase"])
    essential = _pairs(listed(main), weighed.where("essential"), where)
    parts, others = essential, {p for _, p, e in needed if not e}
    if others:
        essential = settled(essential)
        candidates = essential.select("query_id", *KEY).distinct()
        added = _pairs(listed(others), weighed.where("not essential"), where).join(candidates, ["query_id", *KEY], "left_semi")
        parts = essential.unionByName(added)
    weight = F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * ((1 - BM25_B) + BM25_B * F.col("dl") / F.lit(indexed.average)))
    return parts.groupBy("query_id", *KEY).agg(_added(F.col("times") * F.col("idf") * weight).alias("score"))


def _pairs(found: DataFrame, weights: DataFrame, where: Filters | None) -> DataFrame:
    """``query_id, doc_id, ordinal, f, dl, idf, times`` of a query's phrases in the chunks that pass."""
    kept = found.where((where or Filters()).column()).join(F.broadcast(weights.select("query_id", "phrase", "idf", "times")), "phrase")
    return kept.select("query_id", *KEY, "f", "dl", "idf", "times")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query, ties by the key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("query_id", *KEY, "score", "rank")


def knn(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, where: Filters | None = None, width: int | None = None) -> DataFrame:
    """The nearest k chunks of each query (query_id, embedding) by Euclidean distance in double
    precision, the score its negative. Filters apply before k; chunks without a vector are
    never reached; a query of another width than the index (``width``, or that of one of its
    vectors) is refused.

    The queries' matrix goes with the tasks. A task takes Arrow batches of vectors, works out
    a block of distances at a time and hands on the k best of each query in a batch, so what
    is shuffled is k rows a query and batch, however many chunks there are.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select("query_id", F.col("embedding").alias("asked")).collect()
    if width is None:
        one = chunks.where("embedding is not null").select(F.size("embedding").alias("w")).limit(1).collect()
        width = one[0].w if one else None
    if width is not None and any(len(r.asked) != width for r in asked):
        raise ValueError("a query's width differs from the index's")
    candidates = chunks.where((where or Filters()).column() & F.col("embedding").isNotNull()).select(*KEY, "embedding")
    kind = queries.schema["query_id"].dataType.simpleString()
    run = _nearest([r.query_id for r in asked], to_arrow_type(queries.schema["query_id"].dataType), [list(r.asked) for r in asked], k)
    found = candidates.mapInArrow(run, f"query_id {kind}, doc_id string, ordinal int, score double")
    return top(found, k)


def _nearest(ids: list, kind, vectors: list, k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = np.array(vectors, dtype=np.float64)
        for batch in batches:
            if not batch.num_rows or not len(asked):
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if x.shape[1] != asked.shape[1]:
                raise ValueError("a chunk's vector is of another width than the queries'")
            out = []
            for q, a in zip(ids, asked):
                d = x - a
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                # all that reach the k-th distance: ties are settled by the key later
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                out.append((near, [q] * len(near), -d[near] + 0.0))
            rows = pa.array(np.concatenate([o[0] for o in out]))
            some = batch.select(["doc_id", "ordinal"]).take(rows)
            yield pa.RecordBatch.from_arrays([pa.array([q for o in out for q in o[1]], kind), some.column(0), some.column(1), pa.array(np.concatenate([o[2] for o in out]))], names=["query_id", "doc_id", "ordinal", "score"])

    return run


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, doc_id, ordinal, score, position``; ties go to the
    chunk seen first, lists in their order."""
    union = None
    for n, found in enumerate(lists):
        part = found.select("query_id", *KEY, F.lit(n).alias("list"), "rank")
        union = part if union is None else union.unionByName(part)
    total = union.groupBy("query_id", *KEY).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen")
    return total.withColumn("position", F.row_number().over(order).cast("bigint")).drop("seen")


def hybrid(indexed: Index, queries: DataFrame, k: int = TOP_K, where: Filters | None = None) -> DataFrame:
    """Both searches under the same filter, fused; up to 2k chunks a query, not cut again."""
    return fuse(bm25(indexed, queries, k, where), knn(indexed.chunks, queries, k, where))


def lift(fused: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The best chunk of each document in fusion order, with the document's attributes;
    documents that are missing or have no address are dropped."""
    best = Window.partitionBy("query_id", "doc_id").orderBy("position")
    one = fused.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    texts = chunks.select(*KEY, F.col("text").alias("excerpt"))
    known = documents.where(F.coalesce(F.col("url"), F.lit("")) != "").select("doc_id", "source", "type", "title", "url", "created_at")
    # what was found is sent to the texts, twice k rows a query, so that no text of the corpus is shuffled
    found = known.join(F.broadcast(one), "doc_id")
    columns = [*KEY, *(c for c in one.columns if c not in KEY), "excerpt", *known.columns[1:]]
    return texts.join(F.broadcast(found), KEY).select(*columns).withColumnRenamed("score", "relevance")
