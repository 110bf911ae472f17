"""Queries whose operators number or index whole tables, held against plain code."""

import collections
import re
import unicodedata

from pyspark.sql import functions as F

from veritrail.operators import search as S
from veritrail.operators import store
from veritrail.plans import catalog

from .compare import DATA, connection, rows

FOLDER = f"{DATA}/sf0.01"


def test_blame_counts_every_event(spark):
    found = catalog.QUERIES["blame_group"](spark, FOLDER).toPandas()
    assert found.lines.sum() == connection(FOLDER).sql("select count(*) from events").fetchall()[0][0]


def test_postings_of_every_document(spark):
    found = catalog.QUERIES["postings"](spark, FOLDER).toPandas()
    keys = {n: key for n, key in connection(FOLDER).sql(f"select n, doc_id from ({catalog.T.DOCS})").fetchall()}
    want = set()
    for n, text in connection(FOLDER).sql("select doc_id, coalesce(text, '') from documents").fetchall():
        plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
        want |= {(term, keys[n], tf) for term, tf in collections.Counter(re.findall(r"[^\W_]+", plain)).items()}
    assert set(found.itertuples(index=False, name=None)) == want and len(found) == len(want)


def test_stored_postings_give_what_the_chunks_give(spark, tmp_path):
    chunks = catalog.T.chunks(spark, f"{DATA}/sf0.001")
    stored, loose = S.write_index(chunks, str(tmp_path)), S.index(chunks)
    assert (stored.n, stored.average) == (loose.n, loose.average)
    ask = catalog.asked(spark)
    rows = lambda i: [(r.query_id, r.doc_id, round(r.score, 9), r.rank) for r in S.bm25(i, ask).orderBy("query_id", "rank").collect()]
    assert rows(stored) == rows(loose) != []


def test_a_query_reads_the_parts_of_its_words_alone(spark, tmp_path, monkeypatch):
    """Of an index of many parts a search opens those of its words, and tests the word at the scan."""
    monkeypatch.setattr(store.Tables.__init__, "__defaults__", (store.FAN, 1 << 16))
    stored = S.write_index(catalog.T.chunks(spark, f"{DATA}/sf0.001"), str(tmp_path))
    found = stored.holding(["license"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = {f.split("part=")[1].split("/")[0] for f in found.inputFiles()}
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(term,license\)", plan)
    [segment] = stored.stored.state("postings")[1]
    assert segment.parts >= 8 and len(opened) == 1 and {r.term for r in found.collect()} == {"license"}


def test_a_history_needs_no_index(spark, monkeypatch):
    """A verb that searches nothing wrote the whole index of the folder's texts first."""
    monkeypatch.setattr(catalog, "_indexed", lambda *_: 1 / 0)
    found = catalog.QUERIES["history_of"](spark, f"{DATA}/sf0.001")
    assert rows(found.toPandas()) == rows(connection(f"{DATA}/sf0.001").sql(catalog.SQL["history_of"]).df())
