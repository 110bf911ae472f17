"""Remote sources followed as streams, over a transport that answers from a file of lists."""

import json
from pathlib import Path

import pytest

from veritrail.operators import store
from veritrail.sources import fetch, follow, forge
from veritrail.streaming.sync import Sync

T = "2024-06-{:02}T10:00:00Z"


def lists(options):
    """A forge with numbered pages: commits, merge requests and issues of a file, newest or oldest
    first, between two times, a hundred a page; each request is appended to a log."""
    data, log = Path(options["data"]), Path(options["data"] + ".log")

    def send(request):
        with log.open("a") as f:
            f.write(request.path + "\n")
        p = request.params
        parts = request.path.split("/")
        kind = parts[3] if parts[3] != "repository" else "commits"
        if len(parts) > (4 if kind != "commits" else 5):
            return fetch.Response(200, [])  # details
        rows = json.loads(data.read_text())[parts[2].replace("%2F", "/")].get(kind, [])
        at = "committed_date" if kind == "commits" else "updated_at"
        low, high = p.get("updated_after") or p.get("since"), p.get("updated_before") or p.get("until")
        rows = [r for r in rows if (not low or r[at] >= low) and (not high or r[at] <= high)]
        rows = sorted(rows, key=lambda r: r[at], reverse=kind == "commits" or p.get("sort") == "desc")
        n = p["per_page"]
        return fetch.Response(200, rows[(p["page"] - 1) * n : p["page"] * n])

    return send


def merge(n, day, title="t"):
    who = {"username": "ann", "name": "A"}
    return {"iid": n, "title": title, "description": f"closes !{n + 1}", "web_url": f"https://g/{n}", "source_branch": "x", "author": who, "created_at": T.format(1), "updated_at": T.format(day)}


def commit(n, day):
    return {"id": f"{n:040x}", "title": f"c{n}", "message": "m", "author_name": "B", "committed_date": T.format(day), "authored_date": T.format(day), "created_at": T.format(day), "web_url": f"https://g/c{n}"}


class Service:
    def __init__(self, path):
        self.path, self.data = path, {"g/p": {}, "g/q": {}}
        self.save()

    def save(self):
        self.path.write_text(json.dumps(self.data))

    def add(self, slug, kind, *rows):
        found = {r.get("iid", r.get("id")): r for r in [*self.data[slug].get(kind, []), *rows]}
        self.data[slug][kind] = list(found.values())
        self.save()

    @property
    def options(self):
        return {"source": "gitlab", "slugs": "g/p,g/q", "transport": "tests.test_follow:lists", "data": str(self.path)}

    def requests(self):
        log = Path(f"{self.path}.log")
        found = log.read_text().splitlines() if log.exists() else []
        log.write_text("")
        return found


def seen(spark, service, marks, **more):
    """What one run of the stream delivers."""
    out = []
    stream = spark.readStream.format("remote").options(**service.options, **more).load()
    query = stream.writeStream.foreachBatch(lambda batch, n: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((kind, json.loads(value)["slug"], json.loads(value).get("iid") or int(json.loads(value)["id"], 16)) for kind, value in out)


def test_nothing_is_lost_over_restarts(spark, tmp_path):
    spark.dataSource.register(fetch.Remote)
    service, marks = Service(tmp_path / "lists.json"), str(tmp_path / "marks")
    assert seen(spark, service, marks) == []
    service.add("g/p", "merge_requests", merge(1, 1), merge(2, 2), merge(3, 2))
    service.add("g/q", "commits", commit(1, 1))
    assert seen(spark, service, marks) == [("commits", "g/q", 1), ("merge_requests", "g/p", 1), ("merge_requests", "g/p", 2), ("merge_requests", "g/p", 3)]
    assert seen(spark, service, marks) == []
    # another change of the mark's own time: that time is read again, and nothing before it
    service.add("g/p", "merge_requests", merge(4, 2))
    assert seen(spark, service, marks) == [("merge_requests", "g/p", n) for n in (2, 3, 4)]
    # an old one changes, and a list that was empty begins; the other lists aren't asked for nodes
    service.add("g/p", "merge_requests", merge(1, 3, "new"))
    service.add("g/q", "issues", {"iid": 9, "updated_at": T.format(3)})
    service.requests()
    assert seen(spark, service, marks) == [("issues", "g/q", 9), *(("merge_requests", "g/p", n) for n in (1, 2, 3, 4))]
    assert not [r for r in service.requests() if r.endswith("/diff")]
    # the newest is gone: there is nothing to read
    service.data["g/q"]["issues"] = []
    service.save()
    assert seen(spark, service, marks) == []
    # a stream without a checkpoint that starts at a time
    assert seen(spark, service, str(tmp_path / "other"), since=T.format(3)) == [("merge_requests", "g/p", 1)]


def test_a_failed_batch_comes_again(spark, tmp_path):
    spark.dataSource.register(fetch.Remote)
    service, marks = Service(tmp_path / "lists.json"), str(tmp_path / "marks")
    service.add("g/p", "merge_requests", merge(1, 1))

    def broken(batch, n):
        raise RuntimeError("lost")

    stream = spark.readStream.format("remote").options(**service.options).load()
    with pytest.raises(Exception, match="lost"):
        stream.writeStream.foreachBatch(broken).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    service.add("g/p", "merge_requests", merge(2, 2))
    assert seen(spark, service, marks) in ([("merge_requests", "g/p", 1)], [("merge_requests", "g/p", 1), ("merge_requests", "g/p", 2)])
    assert seen(spark, service, str(tmp_path / "all")) == [("merge_requests", "g/p", 1), ("merge_requests", "g/p", 2)]


def test_a_round_follows_to_the_store(spark, tmp_path):
    """Reader, normaliser, store and cursor joined: a second round reads what changed, and a store
    whose checkpoints are lost starts from its cursor."""
    spark.dataSource.register(fetch.Remote)
    service = Service(tmp_path / "lists.json")
    service.add("g/p", "merge_requests", merge(1, 1), merge(2, 2))
    sync = Sync(spark, store.Tables(spark, str(tmp_path / "store")))
    source = lambda: {"gitlab": sync.follow("gitlab", service.options, lambda batch: forge.gitlab(spark, batch))}
    assert sync.run(source(), str(tmp_path / "marks")) == {}
    ids = lambda t, c: sorted(r[0].rsplit("/", 1)[1] for r in sync.tables.read(t).select(c).collect())
    assert ids("documents", "doc_id") == ["1", "2"] and ids("edges", "src") == ["1"] and sync.cursor("gitlab")["updated_at"] == T.format(2)
    service.add("g/p", "merge_requests", merge(3, 4))
    service.requests()
    assert sync.run(source(), str(tmp_path / "fresh")) == {}
    assert ids("documents", "doc_id") == ["1", "2", "3"] and ids("edges", "src") == ["1", "2"] and sync.cursor("gitlab")["updated_at"] == T.format(4)
    assert not any("merge_requests/1/" in r for r in service.requests())


def test_details_are_dealt_to_tasks(spark, tmp_path):
    """A listing with one request a page, then the requests for each node in as many tasks as asked."""
    spark.dataSource.register(fetch.Remote)
    service = Service(tmp_path / "lists.json")
    service.add("g/p", "merge_requests", *(merge(n, 1) for n in range(1, 41)))
    rows = spark.read.format("remote").options(**service.options, details="false").load()
    assert rows.count() == 40 and not any("discussions" in r for r in service.requests())
    found = fetch.detailed(rows, service.options, tasks=4)
    assert found.rdd.getNumPartitions() == 4 and all("discussions" in json.loads(r.value) for r in found.collect())
    assert sum("discussions" in r for r in service.requests()) == 40
    waits, now = [], [0.0]
    paced = fetch.Paced(lambda r: fetch.Response(200), 2.0, sleep=waits.append, clock=lambda: now[0])
    for _ in range(3):
        paced(fetch.Request("GET", "/x"))
    assert waits == [0.5, 1.0]


def test_marks_of_every_source():
    def client(answer):
        return fetch.Client(lambda request: fetch.Response(200, answer(request)), sleep=lambda s: None)

    graph = client(lambda r: {"data": {"repository": {"issues": {"nodes": [{"number": 2, "updatedAt": T.format(3)}, {"number": 1, "updatedAt": T.format(3)}, {"number": 5, "updatedAt": T.format(2)}], "pageInfo": {"hasNextPage": True, "endCursor": "x"}}}}})
    assert follow.mark(graph, "github", "issues", "o/r")["at"] == T.format(3)
    tickets = client(lambda r: {"issues": [{"key": "AB-1", "fields": {"updated": "2024-06-02T12:00:00.500+0200"}}], "isLast": True})
    assert follow.mark(tickets, "jira", "tickets", "AB")["at"] == "2024-06-02T10:00:00.500000Z"
    wiki = client(lambda r: {"results": [{"id": "a", "last_edited_time": "2024-06-02T10:00:00.000Z"}], "has_more": False})
    assert follow.mark(wiki, "notion", "pages", "")["at"] == T.format(2)
    assert follow.mark(client(lambda r: {"results": [], "has_more": False}), "notion", "pages", "") is None
