import json
import subprocess
from datetime import datetime, timezone

import pytest

from veritrail.operators import store
from veritrail.sources import changes, code, forge, trackers
from veritrail.streaming.sync import PHASES, LostLease, Sync

T = "2024-06-0{}T10:00:00Z"


def write(folder, kind, rows):
    (folder / kind).mkdir(parents=True)
    (folder / kind / "a.json").write_text("\n".join(map(json.dumps, rows)))


def test_github(spark, tmp_path):
    who = {"login": "ann"}
    write(tmp_path, "commits", [{"slug": "o/r", "oid": "a" * 40, "url": "https://g/c", "messageHeadline": "fix", "message": "fix PROJ-1 (#7)", "committedDate": T.format(2), "authoredDate": T.format(1), "author": {"name": "Ann"}, "associatedPullRequests": {"nodes": [{"number": 7}]}, "files": [{"filename": "b.py", "previous_filename": "a.py"}]}])
    comment = {"databaseId": 5, "body": "why?", "path": "b.py", "url": "https://g/pr#discussion_r5", "author": who, "createdAt": T.format(3), "updatedAt": None}
    review = {"id": "x", "databaseId": 4, "state": "CHANGES_REQUESTED", "body": "no", "url": "https://g/pr#pullrequestreview-4", "author": who, "createdAt": T.format(3), "updatedAt": T.format(3), "comments": {"nodes": [comment]}}
    write(tmp_path, "prs", [{"slug": "o/r", "number": 7, "title": "t", "body": None, "url": "https://g/pr", "createdAt": T.format(1), "updatedAt": T.format(4), "headRefName": "feature/PROJ-9-x", "author": who, "closingIssuesReferences": {"nodes": [{"number": 3}]}, "commits": {"nodes": [{"commit": {"oid": "a" * 40}}]}, "reviews": {"nodes": [review]}}])
    write(tmp_path, "issues", [{"slug": "o/r", "number": 3, "title": "bug", "body": "see other/repo#1", "url": "https://g/3", "createdAt": T.format(1), "updatedAt": T.format(1), "author": who, "comments": {"nodes": [{"databaseId": 8, "body": "me too", "url": "", "author": who, "createdAt": T.format(2), "updatedAt": T.format(2)}]}}])
    found = {r.doc_id: r for r in forge.github(spark, str(tmp_path)).collect()}
    assert set(found) == {
        f"github:commit:o/r/commit/{'a' * 40}", "github:pr:o/r/pull/7", "github:issue:o/r/issues/3", "github:pr_review:o/r/pull/7#pullrequestreview-4",
        "github:review_comment:o/r/pull/7#discussion_r5", "github:issue_comment:o/r/issues/3#issuecomment-8",
    }
    refs = lambda d: [(r.kind, r.value, r.instance) for r in found[d].refs]
    assert refs(f"github:commit:o/r/commit/{'a' * 40}") == [("pr_number", "o/r#7", "github"), ("file_path", "b.py", ""), ("file_path", "a.py", ""), ("ticket_key", "PROJ-1", "")]
    assert refs("github:pr:o/r/pull/7") == [("pr_number", "o/r#3", "github"), ("commit_sha", "a" * 40, ""), ("ticket_key", "PROJ-9", "")]
    assert refs("github:issue:o/r/issues/3") == [("pr_number", "other/repo#1", "")]
    made = found["github:review_comment:o/r/pull/7#discussion_r5"]
    assert made.updated_at == made.created_at and refs(made.doc_id)[0] == ("file_path", "b.py", "")


def test_gitlab(spark, tmp_path):
    who = {"username": "bo", "name": "Bo"}
    note = lambda i, system=False, **k: {"id": i, "body": f"n{i}", "system": system, "author": who, "created_at": T.format(2), "updated_at": T.format(2), **k}
    write(tmp_path, "commits", [{"slug": "g/s/p", "id": "b" * 40, "title": "t", "message": "m !4", "author_name": "Bo", "web_url": "", "authored_date": T.format(1), "committed_date": T.format(1), "diffs": [{"new_path": "n.py", "old_path": "o.py", "renamed_file": True}]}])
    write(tmp_path, "merge_requests", [{"slug": "g/s/p", "iid": 4, "title": "t", "description": "d #2", "web_url": "https://l/4", "source_branch": "x", "sha": "c" * 40, "merge_commit_sha": None, "squash_commit_sha": "", "author": who, "created_at": T.format(1), "updated_at": T.format(1), "commits": [{"id": "b" * 40}], "discussions": [{"individual_note": False, "notes": [note(1, True), note(2), note(3)]}, {"individual_note": True, "notes": [note(4)]}, {"individual_note": True, "notes": [note(5, True)]}]}])
    write(tmp_path, "issues", [{"slug": "g/s/p", "iid": 2, "title": "t", "description": "d", "web_url": "https://l/i2", "author": who, "created_at": T.format(1), "updated_at": T.format(1), "notes": [note(6), note(7, True)]}])
    found = {r.doc_id: r for r in forge.gitlab(spark, str(tmp_path)).collect()}
    kinds = sorted((r.type, r.doc_id.split(":", 2)[2]) for r in found.values())
    assert kinds == [("commit", f"g/s/p/commit/{'b' * 40}"), ("issue", "g/s/p/issues/2"), ("issue_comment", "g/s/p/issues/2#note_6"), ("pr", "g/s/p/pull/4"), ("pr_review", "g/s/p/pull/4#note_2"), ("review_comment", "g/s/p/pull/4#note_3"), ("review_comment", "g/s/p/pull/4#note_4")]
    commit = found[f"gitlab:commit:g/s/p/commit/{'b' * 40}"]
    assert commit.url == f"https://gitlab.com/g/s/p/-/commit/{'b' * 40}" and [r.value for r in commit.refs] == ["n.py", "o.py", "g/s/p#4"]
    assert [r.value for r in found["gitlab:pr:g/s/p/pull/4"].refs] == ["b" * 40, "c" * 40, "g/s/p#2"]


def test_jira_and_notion(spark, tmp_path):
    text = lambda s: json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": s}]}]})
    stamp = "2024-06-03T10:00:00.000+0000"
    (tmp_path / "j.json").write_text(json.dumps({"key": "INC-1", "summary": "down", "description": text("INC-1 and INC-2"), "reporter": "ann", "created": stamp, "updated": stamp, "comments": [{"id": "9", "body": text("see src/a.py"), "author": "bo", "created": stamp, "updated": stamp}]}))
    found = {r.doc_id: r for r in trackers.jira(spark, f"{tmp_path}/j.json").collect()}
    assert found["jira:ticket:INC-1"].title == "INC-1: down" and [r.value for r in found["jira:ticket:INC-1"].refs] == ["INC-2"]
    assert found["jira:ticket_comment:INC-1#9"].url.endswith("/browse/INC-1?focusedCommentId=9") and [(r.kind, r.instance) for r in found["jira:ticket_comment:INC-1#9"].refs] == [("ticket_key", "jira"), ("file_path", "")]
    assert trackers.jql(["A", "B"], datetime(2024, 6, 3, tzinfo=timezone.utc)) == 'project IN (A, B) AND updated >= "2024-06-02 00:00" ORDER BY updated ASC'
    with pytest.raises(ValueError):
        trackers.jql(["a"], None)
    key = lambda n: f"{n:032x}"
    page = lambda n, up=None, **k: {"id": key(n), "created_time": T.format(1), "last_edited_time": T.format(n), "url": f"https://n/{n}", "parent": {"type": "page_id", "page_id": up and key(up)}, "properties": json.dumps({"Name": {"id": "t", "type": "title", "title": [{"plain_text": f"P{n}"}]}, "Rel": {"id": "r", "type": "relation", "relation": [{"id": key(1)}]}}), "blocks": json.dumps([{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "body"}]}}]), **k}
    rows = [page(1), page(2, 1), page(3, 2), page(4), page(5, 1, in_trash=True)]
    (tmp_path / "n.json").write_text("\n".join(map(json.dumps, rows)))
    roots = spark.createDataFrame([(key(1),)], "id string")
    pages = trackers.notion(spark, f"{tmp_path}/n.json", roots=roots).collect()
    assert [r.title for r in pages] == ["P1", "P2", "P3"] and pages[1].body == "body" and pages[1].refs[0].value == f"https://www.notion.so/{key(1)}"
    raw = spark.read.schema(trackers.PAGES).json(f"{tmp_path}/n.json")
    assert trackers.root_by_title(raw, "P4") == key(4)
    with pytest.raises(ValueError):
        trackers.root_by_title(raw, "P9")


def document(i, at, refs=(), body="text"):
    return {"doc_id": f"jira:ticket:AB-{i}", "source": "jira", "type": "ticket", "repo_ref": "", "title": f"AB-{i}", "body": body, "author": "", "url": f"https://j/{i}", "created_at": at, "updated_at": at, "refs": [{"kind": "ticket_key", "value": r, "instance": ""} for r in refs]}


def test_frames(spark, tmp_path):
    good = [{"type": "batch", "documents": [document(1, T.format(1))], "cursor": {"after": "1"}}, {"type": "done"}]
    (tmp_path / "good").write_text("\n".join(map(json.dumps, good)))
    assert [r.doc_id for r in changes.frames(spark, f"{tmp_path}/good").collect()] == ["jira:ticket:AB-1"]
    for n, bad in enumerate(({"type": "batch", "documents": []}, {"type": "done", "documents": [document(1, T.format(1))]}, {"type": "odd"})):
        (tmp_path / f"bad{n}").write_text(json.dumps(bad))
        with pytest.raises(store.BadRequest):
            changes.frames(spark, f"{tmp_path}/bad{n}")


def test_batches_never_split_a_time():
    rows = [{"updated_at": t} for t in "aabbbbc"]
    assert [len(b) for b in changes.batches(rows, 3, whole_times=True)] == [6, 1] and [len(b) for b in changes.batches(rows, 3)] == [3, 3, 1]


def test_retry():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise changes.Transient("busy", 5.0 if left[0] == 1 else None)
        return "ok"

    assert changes.retrying(call, sleep=waits.append) == "ok" and 0.25 <= waits[0] <= 0.5 and waits[1] == 5.0
    with pytest.raises(changes.Transient):
        changes.retrying(lambda: (_ for _ in ()).throw(changes.Transient("x")), attempts=2, sleep=waits.append)
    assert list(changes.pages(lambda t: ([1, 2], "n") if t is None else ([3], None))) == [1, 2, 3]


def test_stream_is_resumed_and_equals_batch(spark, tmp_path):
    spark.dataSource.register(changes.RecordedChanges)
    rows = [document(i, T.format(1 + i // 3), [f"AB-{i + 1}"]) for i in range(1, 8)]
    path = tmp_path / "changes.json"
    path.write_text("\n".join(map(json.dumps, rows[:4])))
    assert spark.read.format("changes").option("path", str(path)).load().count() == 4
    tables = store.Tables(spark, str(tmp_path / "store"))
    sync = Sync(spark, tables)
    stream = lambda: {"jira": spark.readStream.format("changes").option("path", str(path)).option("batch", "2").load()}
    assert sync.run(stream(), str(tmp_path / "marks")) == {}
    assert tables.read("documents").count() == 4 and {r.value for r in tables.read("pending_refs").collect()} == {"AB-5"}
    path.write_text("\n".join(map(json.dumps, rows)))
    assert sync.run(stream(), str(tmp_path / "marks")) == {}
    assert tables.read("documents").count() == 7 and tables.read("edges").count() == 6 and {r.value for r in tables.read("pending_refs").collect()} == {"AB-8"}
    whole = store.Tables(spark, str(tmp_path / "whole"))
    again = Sync(spark, whole)
    again.guard()
    batch = spark.read.format("changes").option("path", str(path)).load()
    again.apply(batch, "jira")
    again.apply(batch, "jira")
    for name, key in (("documents", ["doc_id"]), ("edges", ["src", "dst"]), ("pending_refs", ["src_doc", "value"]), ("chunks", ["doc_id", "ordinal"])):
        assert sorted(map(tuple, tables.read(name).select(*key).collect())) == sorted(map(tuple, whole.read(name).select(*key).collect()))
    failed = sync.run({"other": spark.readStream.format("changes").option("path", str(path)).load()}, str(tmp_path / "m2"))
    assert "other" in failed and tables.read("documents").count() == 7
    with pytest.raises(store.Precondition):
        Sync(spark, tables, identity="another").guard()
    sync.reembed()
    assert tables.read("chunks").count() == 0 and tables.read("documents").count() == 7


def rows_of(spark, path, rows):
    path.write_text("\n".join(map(json.dumps, rows)))
    return spark.read.format("changes").option("path", str(path)).load()


def test_a_repeated_id_in_a_batch(spark, tmp_path):
    """The row changed last counts, with its references alone."""
    spark.dataSource.register(changes.RecordedChanges)
    tables = store.Tables(spark, str(tmp_path / "store"), fan=3)
    sync = Sync(spark, tables)
    sync.guard()
    many = [document(i, T.format(1), []) for i in range(1, 40)]
    sync.apply(rows_of(spark, tmp_path / "a.json", many), "jira")
    old, new = document(3, T.format(2), ["AB-1"]) | {"body": "older"}, document(3, T.format(5), ["AB-2"]) | {"body": "newer"}
    for batch in ([old, new], [new, old]):
        sync.apply(rows_of(spark, tmp_path / "b.json", batch), "jira")
        assert tables.read("documents").where("doc_id like '%AB-3'").first().body == "newer" and tables.read("documents").count() == 39
        assert [(r.src[-4:], r.dst[-4:]) for r in tables.read("edges").collect()] == [("AB-3", "AB-2")]
    cursor = tables.read("cursors").first().payload
    assert cursor == {"updated_at": T.format(5), "doc_id": new["doc_id"]}
    lost = tables.vacuum("documents")
    assert lost > 0 and tables.vacuum("documents") == 0 and store.Tables(spark, str(tmp_path / "store")).read("documents").count() == 39


def test_two_writers_of_one_table(spark, tmp_path):
    a, b = (store.Tables(spark, str(tmp_path)) for _ in range(2))
    row = spark.createDataFrame([("a", "b", "k", 0.5)], "src string, dst string, kind string, confidence double")
    assert a.read("edges").count() == b.read("edges").count() == 0
    number, _ = b.state("edges")
    a.put("edges", row)
    with pytest.raises(store.Precondition):
        b._commit(number + 1, {"edges": []})
    assert b.read("edges").count() == 1  # a reader finds the other's manifest


def test_lease(spark, tmp_path):
    now = [0.0]
    a, b, c = (store.Lease(spark, str(tmp_path), name, ttl=60.0, clock=lambda: now[0]) for name in "abc")
    assert a.acquire() and not b.acquire() and a.heartbeat()
    now[0] = 50.0
    assert a.heartbeat() and not b.acquire()
    now[0] = 111.0
    assert b.acquire() and not c.acquire() and not a.heartbeat()  # a has been taken over
    a.release()
    assert not c.acquire() and b.heartbeat()
    b.release()
    assert c.acquire()


def test_rounds_hold_the_lease(spark, tmp_path):
    spark.dataSource.register(changes.RecordedChanges)
    path = tmp_path / "changes.json"
    path.write_text("\n".join(json.dumps(document(i, T.format(i), [])) for i in (1, 2)))
    now, root = [0.0], str(tmp_path / "store")
    other = store.Lease(spark, root, "other", clock=lambda: now[0])
    sync = Sync(spark, store.Tables(spark, root), lease=store.Lease(spark, root, "own", clock=lambda: now[0]))
    stream = lambda: {"jira": spark.readStream.format("changes").option("path", str(path)).load()}
    assert other.acquire() and sync.run(stream(), str(tmp_path / "m")) is None and sync.every(stream(), str(tmp_path / "m"), rounds=2, sleep=lambda s: None) == 0
    other.release()
    assert sync.run(stream(), str(tmp_path / "m")) == {}
    told = [i[3] for i in sync.events.items]
    assert told == [p for p in PHASES if p != "failed"]
    assert other.acquire()
    other.release()

    def stolen(batch, instance, now_=None):
        now[0] += 1000
        assert other.acquire()
        sync._still_ours()

    path.write_text(path.read_text() + "\n" + json.dumps(document(3, T.format(3), [])))
    sync.apply = stolen
    with pytest.raises(LostLease):
        sync.run(stream(), str(tmp_path / "m"))
    assert sync.events.items[-1][3] == "failed"


def test_git(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    git("add", "."), git("commit", "-qm", "first")
    (tmp_path / "a.txt").write_text("one\nTWO\nthree\n")
    git("commit", "-qam", "second")
    found = code.blame(spark, str(tmp_path), "a.txt", 1, 3).collect()
    assert [(r.line_start, r.line_end, r.subject, r.lines) for r in found] == [(1, 1, "first", ["one"]), (2, 2, "second", ["TWO"]), (3, 3, "first", ["three"])]
    assert [r.subject for r in code.log(spark, str(tmp_path), "a.txt").orderBy("position").collect()] == ["second", "first"]
    assert code.tracked(spark, str(tmp_path), "a.txt") and not code.tracked(spark, str(tmp_path), "b.txt")
