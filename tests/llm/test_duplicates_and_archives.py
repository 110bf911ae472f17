import random

import numpy as np
import pytest

from veritrail.llm import cap_filters, components, near_duplicates, queries, warc
from veritrail.llm.components import connected_components
from veritrail.llm.shingles import shingles

from ..compare import connection, rows
from . import brute, data

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_sql(spark, name):
    got = rows(queries.QUERIES[name](spark, DATA).toPandas())
    assert got == rows(connection(DATA).sql(queries.SQL[name]).df())


def test_shingle_hashes():
    for text in [r[1] for r in data.rows()] + [data.words(1000, 9) + " " + data.words(1000, 9)]:
        assert len(shingles(text)) == len(brute.shingle_set(text))
    assert np.array_equal(shingles("A b C d e f"), shingles("a B c D e\tf"))


def test_near_duplicates_small(spark):
    made = data.rows()
    found = near_duplicates.near_duplicates(data.documents(spark)).collect()
    want = brute.near_duplicates([r[0] for r in made], [r[1] for r in made])
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted(((r[0], c) for r, c in zip(made, want)), key=repr)
    assert near_duplicates.near_duplicates(data.empty(spark)).count() == 0


def test_near_duplicates_large_groups(spark):
    """A group of near copies in which most pairs fall short of the threshold, so that stars
    alone can't show all links; and many documents that share a passage."""
    rng = random.Random(3)
    base = data.words(200, 7).split()
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    passage = data.words(60, 8)
    texts += [passage + " " + data.words(40, 1000 + i) for i in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    want = dict(zip(ids, brute.near_duplicates(ids, texts)))
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("edges_of_a_task", [components.EDGES, 40])
def test_components(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(components, "EDGES", edges_of_a_task)
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (2000, 2000)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and found[1001] == 1000 and 2000 not in found
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    near = rng.normal(size=(40, 64))
    out = [near[0] + 0.05 * rng.normal(size=64) for _ in range(40)] + list(near) + [near[1]] * 30 + [near[2] * 3]
    made = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    odd = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1.0, 2.0], [1.0, 2.0]]
    return made + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, made[0][1]), (5, made[5][1])]


def test_near_vectors(spark):
    made = vectors()
    table = spark.createDataFrame(made, "vec_id bigint, embedding array<float>").selectExpr("'x' cid", "*", "1 n", "2 filter", "array(1) own", "3 v", "4 root")
    ok = [i for i, (_, v) in enumerate(made) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(made[i][1], dtype=np.float32).astype(float) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.95]
    comp = brute.components([m[0] for m in made], pairs)
    links = [sum(i in p for p in pairs) for i in range(len(made))]
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_vectors(table).collect()), key=repr)
    assert found == sorted(((m[0], n, c) for m, n, c in zip(made, links, comp)), key=repr)
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_blocks_of_a_hot_filter(spark, monkeypatch):
    """Large buckets are cut into blocks; the driver plans them, so a small size shows them."""
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    made = [(i, [float(v) for v in base + 0.1 * rng.normal(size=64)]) for i in range(150)]
    found = cap_filters.near_vectors(spark.createDataFrame(made, "vec_id bigint, embedding array<double>")).collect()
    x = np.array([v for _, v in made])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    degree = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert sum(abs(r.n_links - degree[r.vec_id]) for r in found) <= 0.002 * degree.sum() and {r.component_id for r in found} == {0}


@pytest.mark.parametrize("n, least", [(100, 0.999), (50_000, 0.999), (10**7, 0.99), (10**11, 0.95)])
def test_recall_at_the_threshold(n, least):
    """Pairs at the threshold meet in a filter, however many filters the size of the table asks for."""
    rng, shape = np.random.default_rng(6), cap_filters.shape_for(n)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = [len(np.intersect1d(p, q)) > 0 for p, q in zip(cap_filters.decode(a, shape), cap_filters.decode(b, shape))]
    assert np.mean(met) >= least


PAGES = "page_id bigint, url string, html string, digest string"


def pages():
    long = "<p>" + "é" * 600 + "</p>"
    return [
        (1, "http://a/1", long, "x"), (2, "http://a/2", long, "x"), (3, None, "short", None), (4, "http://a b\n/4", "short", None), (5, "u", None, None), (6, "u", "", None),
        (7, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nfiledesc://x\n" * 40, None), (None, "u", long, None), (2, "http://a/2", long, None), (8, "u", "y" * 999, None), (9, "u", "y" * 999, None), (10, "u", "z" * 1000, None), (11, "u", "z" * 1000, None),
    ]


def test_archives(spark):
    import hashlib

    made = pages()
    most = {}
    for i, _, html, _ in made:
        if html and len(html.encode()) >= 1000 and i is not None:
            most[html] = max(most.get(html, i), i)
    want = []
    for i, _, html, _ in made:
        raw = (html or "").encode()
        first = most.get(html) if len(raw) >= 1000 else None
        again = first is not None and first != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [tuple(r) for r in warc.archive(spark.createDataFrame(made, PAGES)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_arc_versions():
    records = [("http://x/a b", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhello\n\nhttp://fake 0 0 0 5\n"), ("u", "text/plain", b"")]
    for version in (1, 2):
        raw = warc.arc_archive(version, records)
        assert raw.startswith(b"filedesc://") and [r["document"] for r in warc.read_arc(raw)] == [d for _, _, d in records]
        with pytest.raises(ValueError):
            list(warc.read_arc(raw[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"filedesc://x 0 0 t 5\n9 0 x\n"))
    one, two = (warc.to_warc(next(warc.read_arc(warc.arc_archive(v, records)))) for v in (1, 1))
    assert one == two and b"WARC-Record-ID: <urn:uuid:" in one


def test_archives_are_valid_warc(spark, tmp_path):
    """Every file opens with a full warcinfo record, a record is a gzip member, identifiers are
    unique, and a revisit names a response of the archive."""
    import gzip
    import io
    import zlib

    made = pages() + [(20 + i, f"http://long/{i}", "<p>" + "w" * 3000 + str(i % 3), None) for i in range(40)]
    warc.convert(spark.createDataFrame(made, PAGES).select("page_id", "url", "html").repartition(2), f"{tmp_path}/a", file_bytes=2000)
    files = sorted(tmp_path.glob("a/part=*/part-*"))
    assert len(files) > 4
    ids, refers, kinds = [], [], []
    for file in files:
        raw, members = file.read_bytes(), 0
        records = [*warc.read_warc(gzip.GzipFile(fileobj=io.BytesIO(raw)))]
        while raw:
            one = zlib.decompressobj(31)
            assert one.decompress(raw).startswith(b"WARC/1.1\r\n") and one.eof
            raw, members = one.unused_data, members + 1
        assert members == len(records) and records[0][0]["warc-type"] == "warcinfo"
        for headers, _ in records:
            assert {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type"} <= headers.keys()
            kinds.append(headers["warc-type"])
            ids.append(headers["warc-record-id"])
            if headers["warc-type"] == "revisit":
                assert headers["warc-refers-to-target-uri"] and headers["warc-refers-to-date"]
                refers.append(headers.get("warc-refers-to"))
    assert len(ids) == len(set(ids)) and kinds.count("revisit") >= 38
    assert {r for r in refers if r} <= {i for i, k in zip(ids, kinds) if k == "response"} and sum(map(bool, refers)) >= 37
    found = warc.read_back(spark, f"{tmp_path}/a").count()
    assert found == len(made)


def test_a_very_long_payload(spark, tmp_path, monkeypatch):
    long = "é" * 12_000_000  # 24 MB: two members
    out = warc.archive(spark.createDataFrame([(1, "u", long, ""), (2, "u", long, "")], PAGES)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [(1, 24_000_000, "revisit", 2), (2, 24_000_000, "response", None)]
