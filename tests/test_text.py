import pytest
from pyspark.sql import functions as F

from veritrail.functions import chunking, embedding, flatten
from veritrail.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, column, expected",
    [
        ("PROJ-1 and AB2-33, not a-1 or P-1", X.ticket_keys, ["PROJ-1", "AB2-33"]),
        ("see [x](https://a.b/c). and http://d.e/f?g=1;", X.urls, ["https://a.b/c", "http://d.e/f?g=1"]),
        ("deadbee ABCDEF0 0123456789abcdef0123456789abcdef01234567 abc", X.commit_shas, ["deadbee", "0123456789abcdef0123456789abcdef01234567"]),
        ("src/a.py https://x.y/z/w.go lib/b-c/d.ts end.", X.file_paths, ["src/a.py", "lib/b-c/d.ts"]),
    ],
)
def test_scanners(spark, text, column, expected):
    assert one(spark, column(F.lit(text))) == expected


def test_numbers_take_the_documents_repository(spark):
    assert one(spark, X.numbers(F.lit("#12 and x/y#3"), F.lit("me/own"))) == ["me/own#12", "x/y#3"]
    assert one(spark, X.merge_numbers(F.lit("!4 a/b/c#5"), F.lit("g/p"))) == ["g/p#4", "a/b/c#5"]


def test_scoped_reference_supersedes_its_twin(spark):
    found = one(spark, X.ref_set(F.concat(X.refs(F.lit("PROJ-1 PROJ-2 PROJ-1"), F.lit("r/r")), F.array(X.scoped_ref("ticket_key", F.lit("PROJ-1"), F.lit("jira"))))))
    assert [(r.value, r.instance) for r in found] == [("PROJ-2", ""), ("PROJ-1", "jira")]


def test_keys(spark):
    assert one(spark, X.external_id(F.lit("a:b:c:d"))) == "c:d"
    assert one(spark, X.external_id(F.lit("a:b"))) == ""
    assert one(spark, X.thread_id(F.lit("a#b#c"))) == "a#b"
    assert one(spark, X.thread_id(F.lit("#c"))) == "#c"
    assert one(spark, X.sha_prefix(F.lit("g:commit:o/r/commit/ABCDEF0123456789"), F.lit("commit"))) == "abcdef012345"
    assert one(spark, X.sha_prefix(F.lit("g:pr:o/r/pull/1"), F.lit("pr"))) == ""


def test_page_key(spark):
    key = "0123456789abcdef0123456789abcdef"
    dashed = "01234567-89ab-cdef-0123-456789abcdef"
    for url in (f"https://www.notion.so/team/Title-{key}?v=1#x", f"https://x.notion.site/{dashed}"):
        assert one(spark, X.page_key(F.lit(url))) == dashed
    assert one(spark, X.page_key(F.lit(f"https://example.com/{key}"))) is None


@pytest.mark.parametrize("text", ["", "a" * 500, "é" * 400, "a" + "é" * 400, "日本" * 300, "ab" + "😀" * 200, "x" * 499 + "é"])
def test_byte_excerpt(spark, text):
    assert one(spark, X.byte_excerpt(F.lit(text))) == text.encode()[:500].decode(errors="ignore")


def test_capped(spark):
    assert one(spark, X.capped(F.lit("a" * 8000))) == "a" * 8000
    assert one(spark, X.capped(F.lit("a" * 12345))).endswith("[truncated: 8,000 of 12,345 characters shown.]")


def test_dates(spark):
    assert str(one(spark, X.event_date(F.lit("2024-06-03")))) == "2024-06-03 00:00:00"
    assert one(spark, X.event_date(F.lit("the outage"))) is None
    assert str(one(spark, X.event_date(F.lit("2024-06-03T10:00:00+02:00")))) == "2024-06-03 08:00:00"
    assert str(one(spark, X.window_bound(F.lit("2024-06-03"), True))) == "2024-06-03 23:59:59"
    assert str(one(spark, X.ticket_time(F.lit("2024-06-03T10:00:00.123+0200")))) == "2024-06-03 08:00:00.123000"


def test_supersedes_and_citations(spark):
    def test(t):
        return one(spark, X.supersedes(F.lit(t), F.lit("PROJ-7")))

    assert test("This replaces PROJ-7.") and not test("replaces PROJ-71") and not test("PROJ-7\nsuperseded")
    assert one(spark, X.cites(F.lit("as [1] says"), F.lit(2))) and not one(spark, X.cites(F.lit("as [3] says"), F.lit(2)))
    assert not one(spark, X.cites(F.lit("nothing"), F.lit(2))) and one(spark, X.cites(F.lit("[9](link) [1]"), F.lit(1)))


def test_chunker():
    assert chunking.chunk_texts("page", "  ") == []
    assert chunking.chunk_texts("commit", "a\n\nb") == ["a\n\nb"]
    body = "# One\n\n" + "word " * 300 + "\n\n## Two\n\n" + "more " * 300
    found = chunking.chunk_texts("page", body)
    assert len(found) == 2 and found[0].startswith("# One\n\nword") and found[1].startswith("# One\n\n") and "## Two" in found[1]
    fenced = "```\n# not a heading\n```\n\ntext"
    assert [b for b in chunking.blocks(fenced)] == [("```\n# not a heading\n```", 0), ("text", 0)]
    long = "é" * 3000
    assert all(len(c.encode()) <= 2000 + 202 for c in chunking.chunk_texts("page", long))
    assert "".join(chunking.pieces("ab " * 1000, 2000)).replace(" ", "") == "ab" * 1000


def test_flatteners():
    text = {"type": "text", "text": "here", "marks": [{"type": "link", "attrs": {"href": "https://x"}}]}
    item = lambda *c: {"type": "listItem", "content": list(c)}
    p = lambda *c: {"type": "paragraph", "content": list(c)}
    t = lambda s: {"type": "text", "text": s}
    doc = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 2}, "content": [t("Head")]}, p(t("see "), text),
        {"type": "bulletList", "content": [item(p(t("a")), {"type": "bulletList", "content": [item(p(t("b")))]})]},
        {"type": "blockquote", "content": [p(t("q"))]}, {"type": "codeBlock", "attrs": {"language": "go"}, "content": [t("x\ny")]},
        {"type": "tableRow", "content": [{"type": "tableCell", "content": [p(t("1"))]}, {"type": "tableCell", "content": [p(t("2"))]}]},
        {"type": "rule"}, p({"type": "date", "attrs": {"timestamp": "0"}}, {"type": "emoji", "attrs": {"shortName": ":a:"}}),
    ]}
    assert flatten.issue_text(doc) == "## Head\nsee [here](https://x)\n- a\n  - b\n> q\n```go\nx\ny\n```\n1 | 2\n---\n1970-01-01:a:"
    rich = lambda s, **k: {"rich_text": [{"plain_text": s}], **k}
    blocks = [
        {"type": "heading_1", "heading_1": rich("H")}, {"type": "to_do", "to_do": rich("t", checked=True), "children": [{"type": "bulleted_list_item", "bulleted_list_item": rich("u")}]},
        {"type": "code", "code": rich("x", language="py")}, {"type": "divider", "divider": {}}, {"type": "child_page", "child_page": {"title": "C"}, "children": [{"type": "paragraph", "paragraph": rich("hidden")}]},
    ]
    assert flatten.page_text(blocks) == "# H\n- [x] t\n  - u\n```py\nx\n```\n---\nC"
    deep = {"type": "text", "text": "x"}
    for _ in range(40):
        deep = {"type": "panel", "content": [deep]}
    assert flatten.issue_text(deep) == ""


def test_hash_embedder(spark):
    a, b = embedding.hashed(["one two", ""])
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and b == [1.0] + [0.0] * 7
    rows = spark.createDataFrame([("one two",), (None,)], "t string").select(embedding.embed(F.col("t")).alias("e")).collect()
    assert rows[1].e is None and [round(x, 5) for x in rows[0].e] == [round(x, 5) for x in a]


def test_chunks_of_documents_far_in_the_future(spark):
    """Times go through the chunker as they are, also beyond the year 2262, where nanoseconds end."""
    rows = [("s:commit:a#1", "commit", " one ", 2470), ("s:issue_comment:a#2", "issue_comment", "two", 2470), ("s:page:b", "page", None, 1690), ("#x", "ticket_comment", "three", 9999)]
    made = spark.createDataFrame(rows, "doc_id string, type string, body string, year int").selectExpr("*", "'s' source", "'r' repo_ref", "'a' author", "make_timestamp(year, 1, 2, 3, 4, 5.25) created_at", "make_timestamp(year, 1, 2, 3, 4, 6) updated_at")
    found = chunking.chunk(made).join(made.select("doc_id", F.col("created_at").alias("c"), F.col("updated_at").alias("u")), "doc_id").where("created_at = c and updated_at = u")
    assert sorted(map(tuple, found.select("doc_id", "ordinal", "text", "doc_type", "thread_id").collect())) == [
        ("#x", 0, "three", "ticket_comment", "#x"), ("s:commit:a#1", 0, "one", "commit", ""), ("s:issue_comment:a#2", 0, "two", "issue_comment", "s:issue_comment:a"),
    ]


def test_references_are_scanned_once_and_in_linear_time(spark):
    """A set scans its text once, and a run of 60,000 letters doesn't cost its square."""
    import time

    made = X.refs(F.col("t"), F.lit("r/r"))
    scans = lambda c: spark.createDataFrame([("a",)], "t string").select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all")
    assert scans(X.ref_set(made)) == scans(made) == 5
    assert one(spark, X.numbers(F.lit("-a.b/c_d#1x/y#2 /e/f#3 #4a/b/c#5 g/#6"), F.lit("r/r"))) == ["a.b/c_d#1", "x/y#2", "e/f#3", "r/r#4", "b/c#5", "r/r#6"]
    assert one(spark, X.merge_numbers(F.lit("a/b/c!1 a#2 d/e#3!4"), F.lit("r/r"))) == ["a/b/c#1", "r/r#2", "d/e#3", "r/r#4"]
    rows = spark.createDataFrame([("a" * 60_000 + " b/c#1",)], "t string")
    begun = time.monotonic()
    for scan in (X.numbers, X.merge_numbers):
        assert rows.select(scan(F.col("t"), F.lit("r/r")).alias("x")).first().x == ["b/c#1"]
    assert time.monotonic() - begun < 5
