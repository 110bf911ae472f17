import corpus_pipeline
from pyspark.sql import functions as F

from veritrail.llm import language, near_duplicates, pii, toxicity

from . import data

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage held against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema))
    outs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        outs.append((before, docs))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    before, after = outs[0]
    model = language.train(before)
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5)
    before, after = outs[1]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judge = toxicity.train(before, labels)
    assert ids(after) == sorted(r.doc_id for r in before.collect() if judge.score(r.text) < 0.5)
    before, after = outs[2]
    assert ids(after) == ids(near_duplicates.near_duplicates(before).where("kept"))
    before, after = outs[3]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: pii.redacted(r.text) for r in before.collect()}
    before, after = outs[4]
    assert sorted({r.doc_id for r in after.collect()}) == ids(before)


def test_awkward_rows(spark, tmp_path):
    docs = data.documents(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.where(F.col("length") > 2048).isEmpty() and docs.count() > 0


def test_near_dedup_of_repeated_and_missing_ids(spark):
    a, b, c, d = (data.words(80, seed) for seed in (11, 12, 13, 14))
    near = lambda text: text + " tail"
    rows = [
        (1, a), (2, near(a)), (2, b),  # an id over a dropped and a kept text
        (3, c), (3, near(c)), (3, c.upper()), (3, c),  # an id over near copies of itself
        (None, d), (None, near(d)), (None, d),  # a group without ids
        (None, near(b)), (None, a), (None, None), (None, "!"), (4, None), (4, "  "),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert out.schema == docs.schema
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert (1, a) in got and (2, b) in got and (2, near(a)) not in got and (None, near(b)) not in got and (None, a) not in got
    assert sum(i == 3 for i, _ in got) == 1 and sum(t in (d, near(d)) for _, t in got) == 1
    alone = [(None, None), (None, "!"), (4, None), (4, "  ")]
    assert [x for x in alone if x in got] == alone and len(got) == 4 + len(alone)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
