"""The stored index: updates against a whole rewrite, exact pruning, hot words, and what an update writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from veritrail.operators import search as S
from veritrail.operators import store
from veritrail.schema import TABLES

WORDS = ["the"] * 12 + ["of"] * 6 + ["bridge", "river", "vote", "cost", "route", "plan", "north", "deck", "span", "toll"]


def chunks(spark, texts, version=""):
    rows = [(d, o, t, "s", "r", "pr" if int(d[1:]) % 2 else "page", "a", None, None, d, None) for d, parts in texts.items() for o, t in enumerate(parts)]
    return spark.createDataFrame(rows, TABLES["chunks"])


def said(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))


def corpus(rng, n):
    return {f"d{i}": [said(rng) for _ in range(rng.randint(1, 3))] for i in range(n)}


def asked(spark):
    return spark.createDataFrame([(1, "the bridge of the north"), (2, "toll"), (3, "the of"), (4, "vote-cost the"), (5, "absent"), (6, "the absent river river")], "query_id int, text string")


def scores(found):
    return sorted((r.query_id, r.rank, r.doc_id, r.ordinal, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize("part_bytes", [1 << 30, 1024])
def test_updates_equal_a_whole_rewrite(spark, tmp_path, part_bytes):
    """Documents change, shrink, vanish and appear; the index then answers as one made anew, the top
    twelve by the pruned search are those of the full scores, and counts are the same. With tiny
    parts the frequent words are spread."""
    rng = random.Random(6)
    now = corpus(rng, 60)
    tables = store.Tables(spark, str(tmp_path / "a"), fan=3, part_bytes=part_bytes)
    index = S.StoredIndex(tables)
    index.update(chunks(spark, now), spark.createDataFrame([(d,) for d in now], "doc_id string"))
    for _ in range(2):
        touched = rng.sample(sorted(now), 12)
        fresh = {d: [said(rng) for _ in range(rng.randint(1, 3))] for d in touched[:8]} | {f"d{rng.randrange(100, 200)}": [said(rng)] for _ in range(4)}
        gone = set(touched[8:])
        index.update(chunks(spark, fresh), spark.createDataFrame([(d,) for d in {*fresh, *gone}], "doc_id string"))
        now = {d: p for d, p in (now | fresh).items() if d not in gone}
    updated, whole = index.index(), S.index(chunks(spark, now))
    assert (updated.n, round(updated.average, 9)) == (whole.n, round(whole.average, 9))
    for where in (None, S.Filters(doc_type="pr")):
        assert scores(S.bm25(updated, asked(spark), where=where)) == scores(S.bm25(whole, asked(spark), where=where))
    words = {r.term: r.df for r in tables.read("words").collect() if r.df}
    assert words == {r.term: r.df for r in S.postings(chunks(spark, now)).groupBy("term").agg(F.count("*").alias("df")).collect()}
    spread = [s.folder for s in tables.state("postings")[1] if (tmp_path / "a" / "postings" / s.folder.rsplit("/", 1)[1] / "_hot").exists()]
    assert bool(spread) == (part_bytes == 1024)
    if spread:
        hot = {r.term for r in spark.read.parquet(f"{spread[0]}/_hot").collect()}
        assert "the" in hot and spark.read.parquet(spread[0]).where("term = 'the'").select("part").distinct().count() > 2


def test_an_update_delivered_again_changes_nothing(spark, tmp_path):
    rng = random.Random(7)
    index = S.StoredIndex(store.Tables(spark, str(tmp_path)))
    some, ids = chunks(spark, corpus(rng, 10)), spark.createDataFrame([(f"d{i}",) for i in range(10)], "doc_id string")
    state = lambda: (index.index().n, index.index().average, sorted(map(tuple, index.tables.read("words").where("df <> 0").collect())))
    index.update(some, ids)
    before = state()
    index.update(some, ids)
    assert state() == before


def test_an_update_writes_its_own_postings(spark, tmp_path):
    rng = random.Random(8)
    index = S.StoredIndex(store.Tables(spark, str(tmp_path)))
    big = corpus(rng, 400)
    index.update(chunks(spark, big), spark.createDataFrame([(d,) for d in big], "doc_id string"))
    index.update(chunks(spark, {"d1": ["a new bridge"]}), spark.createDataFrame([("d1",)], "doc_id string"))
    base, last = index.tables.state("postings")[1]
    rows = spark.read.parquet(last.folder)
    assert rows.where("not _dead").count() == 3 and rows.count() < 40 and last.bytes < base.bytes


def test_nothing_of_a_transaction_that_fails(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    row = spark.createDataFrame([("a", "b", "k", 0.5)], TABLES["edges"])
    tables.put("edges", row)
    with pytest.raises(ValueError), tables.transaction():
        tables.put("edges", row.withColumn("src", F.lit("c")))
        tables.put("edges_in", row)
        assert tables.read("edges").count() == 2
        raise ValueError("lost")
    assert tables.read("edges").count() == 1 and tables.read("edges_in").count() == 0
    (tmp_path / "_manifests" / "000000000002").write_text("")  # a writer that is at it, or has died
    assert tables.read("edges").count() == 1
    with pytest.raises(store.Precondition):
        tables.put("edges", row)


def test_postings_are_made_of_few_words_at_a_time(spark):
    """A task's batches are cut by their words, not taken whole: none is left out, none has more
    than asked for unless it is one row."""
    import pyarrow as pa

    sizes = [0, 5, 3, 0, 40, 1, 9, 9, 2, 0]
    batch = pa.RecordBatch.from_pydict({"terms": pa.array([[f"w{i}-{k}" for k in range(n)] for i, n in enumerate(sizes)]), "doc_id": pa.array(list(map(str, range(len(sizes)))))})
    parts = list(S._of_words([batch, batch.slice(2, 4), batch.slice(0, 0)], most=10))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [*map(str, range(10)), "2", "3", "4", "5"]
    assert all(p.num_rows == 1 or sum(map(len, p.column("terms").to_pylist())) <= 10 for p in parts)


def test_copies_have_one_score_in_whatever_order_their_words_come(spark):
    """Sums whose last bits follow the order of their terms ranked copies of a text by chance."""
    weights = spark.createDataFrame([(1, p, 1, idf, 1) for p, idf in enumerate([0.1, 0.2, 0.3, 0.7, 1.9])], "query_id int, phrase int, df bigint, idf double, times bigint")
    orders = [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1], [3, 0, 4, 1, 2]]
    found = spark.createDataFrame([(p, 1, f"d{d}", 0, 5) for d, some in enumerate(orders) for p in some], "phrase int, f bigint, doc_id string, ordinal int, dl int").coalesce(1)
    got = S.top(S._totals(found, weights, S.Index(found, 10, 5.0), None), 4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["d0", "d1", "d2", "d3"] and len({r.score for r in got}) == 1


def test_a_part_is_written_by_a_task_of_its_own(spark, tmp_path):
    """Dealt by a hash of their number, several parts met in one task. And a merge of segments shuffles once."""
    tables = store.Tables(spark, str(tmp_path), fan=3, part_bytes=2048)
    row = lambda k: chunks(spark, {f"d{i}": [f"{k} text {i} " + "word " * (i % 50)] for i in range(k, 600)})
    for k in (0, 100, 300):
        tables.put("chunks", row(k), spark.createDataFrame([(f"d{i}",) for i in range(k, k + 20)], "doc_id string") if k else None)
    [one] = tables.state("chunks")[1]
    folder = tmp_path / "chunks" / one.folder.rsplit("/", 1)[1]
    tasks = [f.name.split("-")[1] for f in folder.glob("part=*/*.parquet")]
    assert one.parts > 8 and len(tasks) == len(set(tasks)) > 8
    want = {f"d{i}": 300 if i >= 300 else 100 if i >= 100 else 0 for i in range(600)}
    assert {r.doc_id: int(r.text.split()[0]) for r in tables.read("chunks").collect()} == want
    assert spark.read.parquet(str(folder)).where("_dead").isEmpty()


def test_postings_are_sorted_once_in_parts_that_their_rows_fit_into(spark, tmp_path, monkeypatch):
    """They were sorted as one part, which was then read and sorted again in parts by the bytes of the file, of
    which rows take many times more in memory."""
    tables, seen, written = store.Tables(spark, str(tmp_path), part_bytes=32 << 10), [], store.Tables._written

    def noted(self, name, rows, parts, *rest):
        folder = written(self, name, rows, parts, *rest)
        seen.append((parts, self._size(folder)))
        return folder

    monkeypatch.setattr(store.Tables, "_written", noted)
    made = S.postings(chunks(spark, corpus(random.Random(9), 300)).coalesce(2))
    tables.write("postings", made)
    [(first, size), (parts, _)] = seen
    assert first == 0 and parts * tables.part_bytes >= 4 * size > tables.part_bytes
    rows = lambda df: sorted((r.term, r.doc_id, r.ordinal, r.tf, r.positions) for r in df.collect())
    assert rows(tables.read("postings")) == rows(made)


def test_parts_of_postings_leave_room_for_all_tasks_of_an_executor(spark, tmp_path, monkeypatch):
    """A posting's row takes about 26 times more memory than in the file: parts of a quarter of the usual bytes filled a
    task's share where they were sorted, and whole row groups where they were dealt."""
    tables, tasks, segment = store.Tables(spark, str(tmp_path), part_bytes=1 << 20), [], store.Tables._hot
    monkeypatch.setattr(store, "RAW_BYTES", 64 << 10)

    def noted(self, name, rows, parts):
        size = sum(Path(f.removeprefix("file:")).stat().st_size for f in rows.inputFiles())
        tasks.append((rows.rdd.getNumPartitions(), size, parts))
        return segment(self, name, rows, parts)

    monkeypatch.setattr(store.Tables, "_hot", noted)
    rng = random.Random(9)
    made = S.postings(chunks(spark, {f"d{i}": [" ".join(f"{rng.getrandbits(40):x}" for _ in range(200))] for i in range(300)}).coalesce(1))
    tables.write("postings", made)
    [(read, size, parts)] = tasks
    assert size > 10 * store.RAW_BYTES and read >= size / store.RAW_BYTES
    assert parts * tables.part_bytes >= 16 * size and made.count() == tables.read("postings").count()


def test_the_corpus_is_measured_without_a_row_for_each_chunk_and_part(spark, tmp_path, monkeypatch):
    """Postings lie by word, so each part has nearly all chunks; grouped by chunk they were shuffled parts times chunks."""
    plans, write = {}, store.Tables.write

    def noted(self, name, state):
        plans[name] = state._jdf.queryExecution().executedPlan().toString()
        write(self, name, state)

    monkeypatch.setattr(store.Tables, "write", noted)
    made = chunks(spark, {**corpus(random.Random(5), 60), "d999": [""]})
    index, loose = S.write_index(made, str(tmp_path)), S.index(made)
    assert "hashpartitioning(doc_id" not in plans["corpus"]
    assert (index.n, index.average) == (loose.n, loose.average)


def test_texts_are_not_shuffled_for_the_few_that_were_found(spark):
    made = chunks(spark, corpus(random.Random(3), 40))
    documents = made.selectExpr("doc_id", "'s' source", "'t' type", "'title' title", "case when doc_id like '%7' then '' else doc_id end url", "created_at").distinct()
    fused = spark.createDataFrame([(1, d, 0, 1.0 / p, p) for p, d in enumerate(sorted(r.doc_id for r in documents.collect())[:20], 1)], "query_id int, doc_id string, ordinal int, score double, position bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.lift(fused, made, documents.localCheckpoint())
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.doc_id, r.relevance, r.position, r.url) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert got == {(r.doc_id, r.score, r.position, r.doc_id) for r in fused.collect() if not r.doc_id.endswith("7")} and got


def test_postings_are_dealt_in_blocks_that_hold_every_row(spark, tmp_path):
    """They were shuffled row by row, each with its chunk's texts."""
    made = S.postings(chunks(spark, corpus(random.Random(4), 200)).withColumn("created_at", F.expr("timestamp_seconds(33000000000 + ordinal)")).coalesce(1))
    part = made.withColumn("_dead", F.lit(False)).withColumn("_h", store.Tables.hashed("postings")).withColumn("part", F.col("_h").bitwiseAND(F.lit(3)))
    blocks = part.mapInArrow(store._blocks, "part int, block binary")
    assert blocks.count() == part.select("part").distinct().count() > 1
    assert sorted(map(tuple, blocks.select("block").mapInArrow(store._of_blocks, part.schema).collect()), key=repr) == sorted(map(tuple, part.collect()), key=repr)
    plans, written = [], DataFrameWriter.parquet
    tables = store.Tables(spark, str(tmp_path), part_bytes=16 << 10)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", lambda self, folder: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), written(self, folder))[1])
        tables.write("postings", made)
    dealt = [p for p in plans if "REPARTITION_BY" in p]
    assert dealt and all("block#" in p.split("Exchange")[1].split("\n")[1] for p in dealt)
    assert tables.read("postings").count() == made.count()


def test_an_index_of_texts_that_lie_elsewhere_writes_words_alone(spark, tmp_path):
    """All texts and vectors were joined, shuffled and written again for it."""
    made = chunks(spark, corpus(random.Random(5), 60))
    whole, lean = S.write_index(made, str(tmp_path / "a")), S.write_index(made, str(tmp_path / "b"), made.drop("embedding"))
    assert not (tmp_path / "b" / "chunks").exists() and (lean.n, lean.average) == (whole.n, whole.average)
    assert scores(S.bm25(lean, asked(spark))) == scores(S.bm25(whole, asked(spark))) and "embedding" not in lean.texts.columns
    with pytest.raises(store.Precondition):
        S.StoredIndex(lean.stored).update(made, made.select("doc_id"))


def test_an_update_cuts_texts_once_and_compares_no_postings(spark, tmp_path, monkeypatch):
    """Old postings were put down by themselves, and their keys and the new ones' were shuffled twice to be compared."""
    rng = random.Random(10)
    index = S.StoredIndex(store.Tables(spark, str(tmp_path)))
    now = corpus(rng, 20)
    index.update(chunks(spark, now), spark.createDataFrame([(d,) for d in now], "doc_id string"))
    plans, segment = [], store.Tables._segment
    monkeypatch.setattr(store.Tables, "_segment", lambda self, name, rows, *rest, **more: (plans.append((name, rows._jdf.queryExecution().executedPlan().toString())), segment(self, name, rows, *rest, **more))[1])
    monkeypatch.setattr(S, "settled", lambda df: 1 / 0)
    fresh = {"d3": ["the river river"], "d4": now["d4"], "d50": ["a toll"]}
    index.update(chunks(spark, fresh), spark.createDataFrame([("d3",), ("d4",), ("d5",), ("d50",)], "doc_id string"))
    monkeypatch.undo()
    [plan] = [p for name, p in plans if name == "postings"]
    assert "LeftAnti" not in plan and "terms" not in "".join(p for name, p in plans if name != "postings")
    now = {d: p for d, p in (now | fresh).items() if d != "d5"}
    updated, whole = index.index(), S.index(chunks(spark, now))
    assert (updated.n, round(updated.average, 9)) == (whole.n, round(whole.average, 9))
    assert scores(S.bm25(updated, asked(spark))) == scores(S.bm25(whole, asked(spark)))
    words = {r.term: r.df for r in index.tables.read("words").collect() if r.df}
    assert words == {r.term: r.df for r in S.postings(chunks(spark, now)).groupBy("term").agg(F.count("*").alias("df")).collect()}
