"""Stored tables as merged segments, the link index, and the lease."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import graph, link, store
from veritrail.schema import DOCUMENT, PENDING, TABLES
from veritrail.session import settled

from .test_operators import DAY

EDGE = "src string, dst string, kind string, confidence double"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def pending(spark, rows):
    return spark.createDataFrame([(f"d{i}", "url", f"u{j}", "") for i, j in rows], PENDING)


@pytest.mark.parametrize("part_bytes", [1 << 30, 2048])
def test_segments_hold_what_plain_upserts_would(spark, tmp_path, part_bytes):
    """Random writes and removals against a dictionary; with tiny parts, tables of many parts."""
    rng = random.Random(3)
    tables = store.Tables(spark, str(tmp_path), fan=3, part_bytes=part_bytes)
    state, high = set(), {}
    for step in range(10):
        add = {(rng.randrange(30), rng.randrange(4)) for _ in range(rng.randint(1, 20))}
        drop = {(rng.randrange(30), rng.randrange(4)) for _ in range(rng.randint(0, 10))}
        tables.put("pending_refs", pending(spark, sorted(add)), pending(spark, sorted(drop)) if drop else None)
        state = (state - drop) | add
        edges = [(f"d{rng.randrange(9)}", f"d{rng.randrange(9)}", "k", rng.random()) for _ in range(12)]
        tables.put("edges", spark.createDataFrame(edges, EDGE))
        for e in edges:
            high[e[:3]] = max(high.get(e[:3], 0), e[3])
        if step in (4, 9):
            assert sorted((r.src_doc, r.value) for r in tables.read("pending_refs").collect()) == sorted((f"d{i}", f"u{j}") for i, j in state)
            assert {tuple(r)[:3]: r.confidence for r in tables.read("edges").collect()} == high
            hashes = tables.touched("edges", spark.createDataFrame([("d1",), ("d2",)], "x string"), "x")
            found = tables.read("edges", hashes).where("src in ('d1', 'd2')")
            assert {tuple(r)[:3]: r.confidence for r in found.collect()} == {k: v for k, v in high.items() if k[0] in ("d1", "d2")}
    segments = tables.state("pending_refs")[1]
    assert len(segments) < 7 and tables.vacuum("pending_refs") > 0 and (part_bytes > 4096) == (max(s.parts for s in segments) == 1)
    tables.compact("pending_refs")
    assert len(tables.state("pending_refs")[1]) == 1 and tables.read("pending_refs").count() == len(state)


def test_a_documents_chunks_are_replaced_as_one(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    chunk = lambda d, n: [(d, i, "t", "s", "r", "pr", "a", None, None, d, None) for i in range(n)]
    tables.put("chunks", spark.createDataFrame(chunk("a", 3) + chunk("b", 2), TABLES["chunks"]))
    tables.put("chunks", spark.createDataFrame(chunk("a", 1), TABLES["chunks"]), spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert [(r.doc_id, r.ordinal) for r in tables.read("chunks").collect()] == [("a", 0)]
    tables.wipe_chunks()
    assert tables.read("chunks").count() == 0


def test_a_batch_costs_its_own_bytes(spark, tmp_path):
    """The same batch against a table of 200 rows and one of 2,000 writes as many bytes, and a read
    for its ids opens one part of many."""
    cost = {}
    for n in (200, 2000):
        tables = store.Tables(spark, str(tmp_path / str(n)), part_bytes=8192)
        rows = spark.range(n).select(*(F.concat(F.lit(f"{c} "), F.col("id")).alias(c) if DOCUMENT[c].dataType.simpleString() == "string" else F.lit(DAY).alias(c) for c in DOCUMENT.fieldNames()))
        tables.put("documents", rows)
        tables.put("documents", rows.where("id < 10").withColumn("title", F.lit("new")) if "id" in rows.columns else rows.where("doc_id = 'doc_id 7'").withColumn("title", F.lit("new")))
        base, last = tables.state("documents")[1]
        cost[n] = last.bytes
        one = tables.read("documents", tables.touched("documents", spark.createDataFrame([("doc_id 7",)], "doc_id string"), "doc_id"))
        assert one.where("doc_id = 'doc_id 7'").first().title == "new" and tables.read("documents").count() == n
        assert base.parts == 1 or one.count() < n / 4
    assert cost[2000] < 1.1 * cost[200] and base.parts > 1


def documents(spark, rows):
    """``(number, type, text, address)`` of one repository."""
    key = {"pr": "acme/app/pull/{}", "issue": "acme/app/issues/{}", "commit": "acme/app/commit/{:04x}" + "ab" * 18, "ticket": "PROJ-{}"}
    made = [(f"github:{t}:{key[t].format(n)}", "github", t, "r", f"title {n}", text, "a", url, DAY, DAY) for n, t, text, url in rows]
    return spark.createDataFrame(made, DOCUMENT)


def references(docs):
    found = X.ref_set(X.refs(F.concat_ws("\n", "title", "body"), F.lit("acme/app")))
    return docs.select(F.col("doc_id").alias("src_doc"), F.explode(found).alias("r")).select("src_doc", "r.kind", "r.value", "r.instance")


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["pr", "issue", "commit", "ticket"])
        other = rng.randrange(n)
        said = rng.choice(["see #{0}", "fixes PROJ-{0}", "at {0:04x}" + "ab" * 18, "supersedes #{0}", "src/m{1}.py is touched", "https://ex.test/{0}", "nothing"])
        out.append((i, kind, said.format(other, other % 5), f"https://ex.test/{i}" if rng.random() < 0.7 else ""))
    return out


@pytest.mark.parametrize("seed", [2])
def test_batches_link_what_full_links_do(spark, tmp_path, seed):
    """After each batch, the edges of linking its references and all that waits against all
    documents so far."""
    rows = corpus(seed)
    everything = documents(spark, rows)
    files = everything.where("type = 'commit'").select(F.lit("r").alias("repo"), F.concat(F.lit("src/m"), F.length("title") % 5, F.lit(".py")).alias("path"), F.element_at(F.split("doc_id", "/"), -1).alias("sha"), F.col("created_at").alias("time"))
    tables = store.Tables(spark, str(tmp_path), fan=4)
    index = link.LinkIndex(tables, files)
    random.Random(seed).shuffle(rows)
    edges, waits = (spark.createDataFrame([], TABLES[t]) for t in ("edges", "pending_refs"))
    for at in range(0, len(rows), 20):
        batch = documents(spark, rows[at : at + 20])
        edges, waits = map(settled, link.link(references(batch).unionByName(waits), documents(spark, rows[: at + 20]), edges, waits, files))
        changed = index.arrived(batch)
        tables.put("documents", batch)
        index.link(references(batch).unionByName(index.woken(changed)))
    got = sorted(map(tuple, tables.read("edges").collect()))
    assert got == sorted(map(tuple, edges.collect())) == sorted(map(tuple, tables.read("edges_in").collect())) and {e[2] for e in got} >= {"references_doc", "mentions_path", "mentions_commit"}
    assert sorted(map(tuple, tables.read("pending_refs").collect())) == sorted(map(tuple, waits.collect()))
    assert tables.read("waiting").select(*link.REFERENCE).distinct().count() <= waits.count()


def test_an_address_that_moves(spark, tmp_path):
    """A name goes with the new version of its document, and what waits for the new name wakes."""
    tables = store.Tables(spark, str(tmp_path))
    index = link.LinkIndex(tables)
    for batch in ([(1, "pr", "", "https://ex.test/old")], [(2, "issue", "see https://ex.test/new", "")], [(1, "pr", "", "https://ex.test/new")], [(3, "issue", "see https://ex.test/old", "")]):
        docs = documents(spark, batch)
        changed = index.arrived(docs)
        tables.put("documents", docs)
        index.link(references(docs).unionByName(index.woken(changed)))
    assert [(r.src[-1], r.dst[-1]) for r in tables.read("edges").collect()] == [("2", "1")]
    assert [r.src_doc[-1] for r in tables.read("pending_refs").collect()] == ["3"]


def test_a_batch_looks_up_its_own_names(spark, tmp_path):
    """The plan of a lookup tests the stored hashes of the names asked for, at the scan."""
    tables = store.Tables(spark, str(tmp_path))
    link.LinkIndex(tables).arrived(documents(spark, [(i, "ticket", "", f"https://ex.test/{i}") for i in range(50)]))
    asked = link.asked_keys(spark.createDataFrame([("x", "ticket_key", "PROJ-7", "")], PENDING))
    found = tables.read("keys", tables.touched("keys", asked, "shape", "key"))
    assert "PushedFilters: [" in plan(found) and "_h" in plan(found) and found.count() < 5


def test_one_of_two_holders(spark, tmp_path):
    """An acquire within an acquire: between the first file and the first beat nobody else gets in."""
    inner = store.Lease(spark, str(tmp_path), "inner")
    outer = store.Lease(spark, str(tmp_path), "outer")
    create, seen = outer._create, []

    def creating(name):
        done = create(name)
        if name.endswith(".held"):
            seen.append(inner.acquire())
        return done

    outer._create = creating
    assert outer.acquire() and seen == [False] and outer.heartbeat()
    for _ in range(3):
        outer.heartbeat()
    assert len(outer._listed()) <= 3
    outer.release()
    assert inner.acquire()


def test_a_lease_is_kept_during_a_long_block(spark, tmp_path):
    own, other = (store.Lease(spark, str(tmp_path), n, ttl=1.0) for n in ("own", "other"))
    assert own.acquire()
    with own.kept(every=0.2):
        time.sleep(2)
        assert not other.acquire() and not own.lost
    time.sleep(1.2)
    assert other.acquire() and not own.heartbeat() and own.lost


def test_a_walk_over_stored_edges(spark, tmp_path, monkeypatch):
    """Equal to the walk over a table of edges, by sent frontiers and by shuffled ones; a hop's plan
    has no exchange of edges, and it opens the parts of its frontier alone."""
    rng = random.Random(12)
    rows = {(f"n{rng.randrange(60)}", f"n{min(rng.randrange(60), rng.randrange(60))}", rng.choice(["a", "b"])): rng.choice([0.7, 0.9, 1.0]) for _ in range(150)}
    edges = spark.createDataFrame([(*k, v) for k, v in rows.items()], EDGE)
    tables = store.Tables(spark, str(tmp_path), part_bytes=512)
    for name in ("edges", "edges_in"):
        tables.put(name, edges)
    seeds = spark.createDataFrame([(1, "n5", 1), (1, "n9", 2), (2, "n40", 1)], "query_id int, node string, position int")
    known = edges.select(F.col("src").alias("node")).distinct()
    got = lambda e, **o: sorted((r.query_id, r.node, r.hops, round(r.confidence, 9), r.parent, r.seed) for r in graph.walk(e, seeds, **o).collect())
    stored = graph.StoredEdges(tables)
    for options in ({}, {"direction": "in", "kinds": ["a"]}, {"direction": "out", "depth": 2, "admitted": known}):
        want = got(edges, **options)
        assert got(stored, **options) == want and len(want) > 4
        with monkeypatch.context() as m:
            m.setattr(graph, "SENT", 0)
            assert got(edges, **options) == want
    frontier = seeds.select("node").limit(1)
    assert tables.state("edges")[1][0].parts > 2 and stored.steps(frontier).count() < 20
    joined = stored.steps(frontier).join(F.broadcast(frontier), F.col("node") == F.col("frm"))
    assert "BroadcastHashJoin" in plan(joined) and "Exchange hashpartitioning" not in plan(joined)
