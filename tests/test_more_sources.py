import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from veritrail.functions import display
from veritrail.operators import store
from veritrail.plans import synthesis
from veritrail.sources import changes, fetch, forge, plugin, trackers

T = "2024-06-0{}T10:00:00Z"


def recorded(routes, log=None):
    """A transport over recorded answers: a list is taken item by item, a function is called."""

    def send(request):
        if log is not None:
            log.append(request)
        for (method, path), answer in routes.items():
            if request.method == method and request.path == path:
                answer = answer.pop(0) if isinstance(answer, list) else answer
                return answer(request) if callable(answer) else answer
        return fetch.Response(404)

    return send


def client(routes, log=None):
    return fetch.Client(recorded(routes, log), sleep=lambda s: None)


def test_errors_are_tried_again_or_refused():
    waits = []
    routes = {("GET", "/x"): [fetch.Response(503), fetch.Response(429, headers={"Retry-After": "7"}), fetch.Response(200, {"ok": 1})], ("GET", "/y"): fetch.Response(500)}
    c = fetch.Client(recorded(routes), sleep=waits.append)
    assert c.get("/x").body == {"ok": 1} and waits[1] == 7.0 and 0.5 <= waits[0] <= 1.0
    with pytest.raises(changes.Transient):
        c.get("/y")
    with pytest.raises(store.BadRequest):
        c.get("/nothing")


def graph(nodes, name, more=None):
    return {"data": {"repository": {name: {"nodes": nodes, "pageInfo": {"hasNextPage": bool(more), "endCursor": more}}}}}


def pr(n, day, reviews=None):
    who, none = {"login": "ann"}, {"nodes": [], "pageInfo": {"hasNextPage": False}}
    return {"id": f"PR{n}", "number": n, "title": f"t{n}", "body": "", "url": f"https://g/{n}", "createdAt": T.format(1), "updatedAt": T.format(day), "headRefName": "x", "author": who, "closingIssuesReferences": none, "commits": none, "reviews": reviews or none}


def test_graph_pages_stop_at_the_watermark_and_fill_inner_lists(spark):
    who = {"login": "bob"}
    said = lambda i: {"databaseId": i, "body": f"c{i}", "path": "a.py", "url": f"https://g/7#discussion_r{i}", "author": who, "createdAt": T.format(2), "updatedAt": T.format(2)}
    review = {"id": "R1", "databaseId": 1, "state": "APPROVED", "body": "fine", "url": "https://g/7#pullrequestreview-1", "author": who, "createdAt": T.format(2), "updatedAt": T.format(2), "comments": {"nodes": [said(1)], "pageInfo": {"hasNextPage": True, "endCursor": "c1"}}}
    first = pr(7, 8, {"nodes": [review], "pageInfo": {"hasNextPage": False}})
    answers = [
        graph([first, pr(6, 6)], "pullRequests", "p2"),
        {"data": {"node": {"comments": {"nodes": [said(2)], "pageInfo": {"hasNextPage": False, "endCursor": None}}}}},
        graph([pr(5, 5), pr(4, 4), pr(3, 3)], "pullRequests", "p3"),
    ]
    log = []
    found = list(fetch.github(client({("POST", "/graphql"): [fetch.Response(200, a) for a in answers]}, log), "o/r", "prs", T.format(4)))
    assert [n["number"] for n in found] == [7, 6, 5, 4] and len(log) == 3  # ties stay, the third page isn't asked for
    assert [c["databaseId"] for c in found[0]["reviews"]["nodes"][0]["comments"]["nodes"]] == [1, 2]
    rows = spark.createDataFrame([("prs", json.dumps(n)) for n in found], "kind string, value string")
    made = {r.doc_id for r in forge.github(spark, rows).collect()}
    assert "github:pr:o/r/pull/7" in made and "github:review_comment:o/r/pull/7#discussion_r2" in made


def test_commits_bring_their_files():
    history = {"data": {"repository": {"defaultBranchRef": {"target": {"history": {"nodes": [{"oid": "a" * 40, "committedDate": T.format(2)}], "pageInfo": {"hasNextPage": False, "endCursor": None}}}}}}}
    files = [{"filename": f"f{i}"} for i in range(fetch.PAGE)]
    routes = {("POST", "/graphql"): fetch.Response(200, history), ("GET", f"/repos/o/r/commits/{'a' * 40}"): [fetch.Response(200, {"files": files}), fetch.Response(200, {"files": [{"filename": "new", "previous_filename": "old"}]})]}
    found = list(fetch.github(client(routes), "o/r", "commits"))
    assert len(found[0]["files"]) == fetch.PAGE + 1 and found[0]["files"][-1] == {"filename": "new", "previous_filename": "old"}


def test_numbered_pages_with_and_without_a_header():
    full = [{"n": i} for i in range(fetch.PAGE)]
    with_header = {("GET", "/a"): [fetch.Response(200, [{"n": 1}], {"X-Next-Page": "2"}), fetch.Response(200, [{"n": 2}], {"X-Next-Page": ""})]}
    without = {("GET", "/a"): [fetch.Response(200, full), fetch.Response(200, full), fetch.Response(200, [])]}
    assert [x["n"] for x in fetch.numbered_pages(client(with_header), "/a")] == [1, 2]
    assert len(list(fetch.numbered_pages(client(without), "/a"))) == 2 * fetch.PAGE


def test_tickets_by_token_and_comments_by_offset(spark):
    issue = lambda k: {"key": k, "fields": {"summary": f"s {k}", "description": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "see AB-2"}]}]}, "created": "2024-06-01T10:00:00.000+0000", "updated": "2024-06-02T10:00:00.000+0200", "reporter": {"displayName": "Ann"}}}
    said = lambda i: {"id": i, "body": None, "created": "2024-06-01T10:00:00.000+0000", "updated": None, "author": {"displayName": "Bob"}}
    log = []
    routes = {
        ("GET", "/rest/api/3/search/jql"): [fetch.Response(200, {"issues": [issue("AB-1")], "nextPageToken": "t2", "isLast": False}), fetch.Response(200, {"issues": [issue("AB-2")], "isLast": True})],
        ("GET", "/rest/api/3/issue/AB-1/comment"): [fetch.Response(200, {"comments": [said(1), said(2)], "total": 3}), fetch.Response(200, {"comments": [said(3)], "total": 3})],
        ("GET", "/rest/api/3/issue/AB-2/comment"): fetch.Response(200, {"comments": [], "total": 0}),
    }
    found = list(fetch.jira(client(routes, log), ["AB"]))
    assert [len(t["comments"]) for t in found] == [3, 0] and [r.params.get("startAt") for r in log if "comment" in r.path] == [0, 2, 0]
    rows = spark.createDataFrame([("tickets", json.dumps(t)) for t in found], "kind string, value string")
    made = {r.doc_id: r for r in trackers.jira(spark, rows).collect()}
    assert made.keys() == {"jira:ticket:AB-1", "jira:ticket:AB-2", *(f"jira:ticket_comment:AB-1#{i}" for i in (1, 2, 3))}
    assert made["jira:ticket:AB-1"].body == "see AB-2"


def test_wiki_pages_with_trees_and_long_relations(spark):
    page = {"id": "0" * 32, "created_time": T.format(1), "last_edited_time": T.format(2), "url": "https://w/p", "in_trash": False, "archived": False, "parent": {"type": "workspace"}, "properties": {"Name": {"id": "title", "type": "title", "title": [{"plain_text": "Plan"}]}, "Linked": {"id": "rel", "type": "relation", "relation": [], "has_more": True}}}
    text = lambda i, t, **more: {"id": i, "type": "paragraph", "has_children": False, "paragraph": {"rich_text": [{"plain_text": t}]}} | more
    routes = {
        ("POST", "/v1/search"): fetch.Response(200, {"results": [page], "has_more": False}),
        ("GET", f"/v1/blocks/{page['id']}/children"): [fetch.Response(200, {"results": [text("b1", "one", has_children=True)], "has_more": True, "next_cursor": "n"}), fetch.Response(200, {"results": [{"id": "b2", "type": "child_page", "has_children": True, "child_page": {"title": "x"}}], "has_more": False})],
        ("GET", "/v1/blocks/b1/children"): fetch.Response(200, {"results": [text("b3", "inner")], "has_more": False}),
        ("GET", f"/v1/pages/{page['id']}/properties/rel"): [fetch.Response(200, {"results": [{"relation": {"id": "1" * 32}}], "has_more": True, "next_cursor": "r"}), fetch.Response(200, {"results": [{"relation": {"id": "2" * 32}}], "has_more": False})],
    }
    found = list(fetch.notion(client(routes)))
    blocks = json.loads(found[0]["blocks"])
    assert [b["id"] for b in blocks] == ["b1", "b2"] and blocks[0]["children"][0]["id"] == "b3"
    rows = spark.createDataFrame([("pages", json.dumps(p)) for p in found], "kind string, value string")
    made = trackers.notion(spark, rows).first()
    assert made.title == "Plan" and "inner" in made.body and {r.value[-32:] for r in made.refs} == {"1" * 32, "2" * 32}
    stuck = {("GET", "/v1/blocks/x/children"): fetch.Response(200, {"results": [], "has_more": True, "next_cursor": None})}
    with pytest.raises(store.BadRequest):
        fetch.block_tree(client(stuck), "x")


def test_block_trees_end_at_a_depth():
    endless = lambda r: fetch.Response(200, {"results": [{"id": "b", "type": "paragraph", "has_children": True}], "has_more": False})
    tree, depth = fetch.block_tree(client({("GET", "/v1/blocks/b/children"): endless}), "b"), 0
    while tree:
        tree, depth = tree[0].get("children"), depth + 1
    assert depth == fetch.BLOCK_DEPTH


def recorded_gitlab(options):
    """A transport for the remote data source, found by its name."""
    base = "/projects/g%2Fp"
    note = {"id": 5, "body": "why", "system": False, "author": {"username": "ann"}, "created_at": T.format(2), "updated_at": T.format(2)}
    issue = {"iid": 3, "title": "i", "description": "d", "web_url": "", "author": {"username": "ann"}, "created_at": T.format(1), "updated_at": T.format(2)}
    return recorded({("GET", f"{base}/issues"): fetch.Response(200, [issue]), ("GET", f"{base}/issues/3/notes"): fetch.Response(200, [note]), ("GET", f"{base}/merge_requests"): fetch.Response(200, []), ("GET", f"{base}/repository/commits"): fetch.Response(200, [])})


def test_remote_data_source(spark):
    spark.dataSource.register(fetch.Remote)
    rows = spark.read.format("remote").option("source", "gitlab").option("slugs", "g/p").option("transport", "tests.test_more_sources:recorded_gitlab").load()
    assert rows.rdd.getNumPartitions() == 3
    assert {r.doc_id for r in forge.gitlab(spark, rows).collect()} == {"gitlab:issue:g/p/issues/3", "gitlab:issue_comment:g/p/issues/3#note_5"}


def test_a_recorded_file_is_read_by_ranges(spark, tmp_path):
    spark.dataSource.register(changes.RecordedChanges)
    rows = [{"doc_id": f"s:page:{i}", "source": "s", "type": "page", "title": "é" * (i % 7), "created_at": T.format(1), "updated_at": T.format(1 + i % 9)} for i in range(200)]
    path = tmp_path / "c.json"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    for size in (1, 37, 500, 10**6):
        assert sorted(json.loads(x)["doc_id"] for n in range(0, path.stat().st_size, size) for x in changes._between(str(path), n, min(path.stat().st_size, n + size))) == sorted(r["doc_id"] for r in rows)
    found = spark.read.format("changes").option("path", str(path)).option("range", "3000").load()
    assert found.rdd.getNumPartitions() > 3 and sorted(r.doc_id for r in found.collect()) == sorted(r["doc_id"] for r in rows)


def test_durations():
    assert display.duration("30d") == timedelta(days=30) and display.duration("1h30m") == timedelta(minutes=90) and display.duration("-1.5h") == timedelta(hours=-1.5) and display.duration("0") == timedelta()
    assert display.duration("250ms") == timedelta(milliseconds=250) and display.duration("-2d") == timedelta(days=-2)
    for bad in ("", "d", "3", "1h 2m", "200000d", "1x", "--1s", "-"):
        with pytest.raises(ValueError):
            display.duration(bad)


def test_ages_and_inert_text(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 4, 5, 59, 60, 3599, 3600, 172799, 172800)], "s int")
    assert [r[0] for r in rows.select(display.age(F.col("s"))).collect()] == ["just now", "just now", "5s ago", "59s ago", "1m ago", "59m ago", "1h ago", "47h ago", "2d ago"]
    assert [r[0] for r in rows.limit(0).union(spark.createDataFrame([(1,), (2,)], "s int")).select(display.counted(F.col("s"), "document")).collect()] == ["1 document", "2 documents"]
    texts = spark.createDataFrame([("plain\ttext\n",), ("a\x1b[31mb\x07",), ("x‮y\u0085",), (None,)], "t string")
    assert [r[0] for r in texts.select(display.inert(F.col("t"))).collect()] == ["plain\ttext\n", "a\\x1b[31mb\\a", "x\\u202ey\\u0085", None]
    assert texts.select(display.inert_line(F.col("t"))).first()[0] == "plain\\ttext\\n"


def test_answers_over_bundles(spark):
    shape = "question string, nodes array<struct<rank:bigint,node:string,role:string,score:double,title:string,url:string>>, chains array<array<string>>, gaps array<string>"
    nodes = [(1, "a", "seed", 0.5, "A | B\nC", "https://a"), (2, "b", "linked_change", None, "B", "https://b")]
    made = [("why?", nodes, [["a", "b"], ["a", "gone"]], ["no page"]), ("none", [], [], []), (None, [], [], [])]
    bundles = spark.createDataFrame(made, shape)
    texts = [r[0] for r in bundles.select(synthesis.prompt(*(F.col(c) for c in ("question", "nodes", "chains", "gaps")))).collect()]
    assert texts[0].split("\n") == ["why?", "", "row | title | role | score | address", "1 | A B C | seed | 0.5 | https://a", "2 | B | linked_change |  | https://b", "linked: [1] then [2]", "linked: [1] then gone", "missing: no page"]
    said = {"good": "so [2], and [ 1 ] ", "beyond": "so [3]", "nothing": "so", "link": "see [1](https://a)"}
    for name, text in said.items():
        got = {r.question: r for r in synthesis.answered(bundles, lambda task, prompt, text=text: text).collect()}
        assert got["why?"].grounded == (name == "good") and got["none"].grounded == (name == "nothing") and not got[None].grounded and got[None].answer is None
        assert [(x.row, x.title) for x in got["why?"].sources] == {"good": [(1, "A | B\nC"), (2, "B")], "link": [(1, "A | B\nC")]}.get(name, [])


def test_waits_that_a_service_asks_for():
    assert fetch.wait_of("7", 0) == 7.0 and fetch.wait_of(None, 0) is None and fetch.wait_of("soon", 0) is None
    assert fetch.wait_of("Wed, 21 Oct 2015 07:28:30 GMT", 1445412480) == 30.0 and fetch.wait_of("Wed, 21 Oct 2015 07:28:00 GMT", 2e9) == 0.0
    left, waits = [fetch.Response(429, headers={"Retry-After": "Wed, 21 Oct 2015 07:28:30 GMT"}), fetch.Response(200, [])], []
    assert fetch.Client(lambda request: left.pop(0), sleep=waits.append, now=lambda: 1445412480.0).get("/x").status == 200 and waits == [30.0]


def test_scope_by_doubling(spark):
    """Random trees with cycles, pages without a parent and roots that aren't pages, against walking up."""
    import random

    rng, key = random.Random(4), lambda n: f"{n:032x}"
    up = {i: rng.choice([None, i, *range(1, 80)]) if i % 7 == 0 else max(1, i - rng.choice([1, 1, 2])) for i in range(1, 80)}
    up[3] = 500  # a root that isn't listed
    rows = [(key(i), (("page_id", key(p), None, None) if p else None)) for i, p in up.items()]
    pages = spark.createDataFrame(rows, "id string, parent struct<type:string,page_id:string,block_id:string,database_id:string>")
    for roots in ([20], [500, 41], [999]):
        def reached(n, left=32):
            return n in roots or (left > 0 and up.get(n) is not None and reached(up[n], left - 1))

        got = {r.id for r in trackers.in_scope(pages, spark.createDataFrame([(key(r),) for r in roots], "id string")).collect()}
        assert got == {key(i) for i in up if reached(i)} | {key(r) for r in roots}
    given = pages.withColumn("properties", F.lit(json.dumps({"Name": {"id": "a", "type": "title", "title": [{"plain_text": "T"}]}})))
    assert trackers.root_of(given, "https://www.notion.so/Plan-" + key(5)) == key(5) and trackers.root_of(given.limit(1), "T") == key(1)


def test_manifests():
    m = plugin.Manifest("git-hub", "source", settings=(plugin.Setting("repos", "string_list", True, doc="owner/name"), plugin.Setting("every", "duration"), plugin.Setting("n", "int"), plugin.Setting("on", "bool"), plugin.Setting("at", "url")), secrets=(plugin.Secret("token"),))
    assert m.read({"repos": ["o/r"], "every": "1h", "n": 3, "on": "true", "at": "https://x", "token": "t"}) == {"repos": ["o/r"], "every": timedelta(hours=1), "n": 3, "on": True, "at": "https://x", "token": "t"}
    for bad in ({"repos": ["a"]}, {"token": "t"}, {"repos": "a", "token": "t"}, {"repos": [], "token": "t", "odd": 1}, {"repos": ["a"], "token": "t", "n": "x"}, {"repos": ["a"], "token": "t", "n": True}, {"repos": ["a"], "token": "t", "at": "ftp:x"}):
        with pytest.raises(store.BadRequest):
            m.read(bad)
    for odd in (("A", "source"), ("a", "else")):
        with pytest.raises(store.BadRequest):
            plugin.Manifest(*odd)
    with pytest.raises(store.BadRequest):
        plugin.Manifest("a", "source", settings=(plugin.Setting("x", "date"),))
    assert json.loads(m.json())["capabilities"] == {"embed": False, "complete": False, "repo_remotes": False}
    assert plugin.preset("together").capabilities == {"embed", "complete"} and plugin.preset("groq").capabilities == {"complete"} and len(plugin.PRESETS) == 8


def stream(docs, size=2, cursors=True, repeat=None):
    def changes_of(cursor):
        start = cursor["n"] if cursor else 0
        rows = docs[start:] if repeat is None or not cursor else [docs[repeat], *docs[start:]]
        for at in range(0, len(rows), size):
            yield rows[at : at + size], {"n": start + at + size} if cursors else None

    return changes_of


def test_conformance():
    doc = lambda i, kind="page", **more: {"doc_id": f"s:{kind}:{i}", "source": "s", "type": kind, "url": "u", "created_at": 1, "updated_at": 2} | more
    docs = [doc(i) for i in range(5)]

    def broken():
        yield docs[:1], {"n": 1}
        raise RuntimeError("gone")

    good = plugin.conforms(stream(docs), 5, failing=broken)
    assert good.found == [] and sorted(good.ran) == sorted(plugin.CHECKS)
    assert {k for k, _ in plugin.conforms(stream(docs, cursors=False), 5).found} == {"cursors", "resumable"}
    assert {k for k, _ in plugin.conforms(stream(docs), 6).found} == {"completion"}
    assert {k for k, _ in plugin.conforms(stream([doc(1, updated_at=None), doc(2, url="")]), 2).found} == {"timestamps", "identity"}
    assert {k for k, _ in plugin.conforms(stream([doc(1), doc(1)]), 2).found} == {"identity"}
    assert {k for k, _ in plugin.conforms(stream(docs, repeat=0), 5).found} == {"resumable"}
    commits = [doc(i, "commit") for i in range(5)]
    assert plugin.conforms(stream(commits, repeat=0), 5).found == []
    turns = iter([docs, docs[:4], docs])
    assert "idempotent" in {k for k, _ in plugin.conforms(lambda c: stream(next(turns, docs))(c), 5).found}
    assert {k for k, _ in plugin.conforms(stream(docs), 5, failing=lambda: []).found} == {"error"}
