"""Commits, pull or merge requests, issues and their discussions of two forges as documents.

Each reader takes nodes as the forge's interface returns them, one JSON object a line with the
repository's ``slug``, in a folder for each kind; nested comments are exploded here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DOCUMENT_WITH_REFS

_WHO = "author struct<login:string>"
_TIMES = "createdAt timestamp, updatedAt timestamp"
_COMMENT = f"databaseId bigint, body string, path string, url string, {_WHO}, {_TIMES}"
GITHUB = {
    "commits": "slug string, oid string, url string, messageHeadline string, message string, committedDate timestamp, authoredDate timestamp, author struct<name:string,user:struct<login:string>>, "
    "associatedPullRequests struct<nodes:array<struct<number:bigint>>>, files array<struct<filename:string,previous_filename:string>>",
    "prs": f"slug string, number bigint, title string, body string, url string, {_TIMES}, headRefName string, {_WHO}, closingIssuesReferences struct<nodes:array<struct<number:bigint>>>, "
    "commits struct<nodes:array<struct<commit:struct<oid:string>>>>, "
    f"reviews struct<nodes:array<struct<id:string,databaseId:bigint,state:string,body:string,url:string,author:struct<login:string>,createdAt:timestamp,updatedAt:timestamp,"
    "comments:struct<nodes:array<struct<databaseId:bigint,body:string,path:string,url:string,author:struct<login:string>,createdAt:timestamp,updatedAt:timestamp>>>>>>",
    "issues": f"slug string, number bigint, title string, body string, url string, {_TIMES}, {_WHO}, "
    "comments struct<nodes:array<struct<databaseId:bigint,body:string,url:string,author:struct<login:string>,createdAt:timestamp,updatedAt:timestamp>>>",
}
_NOTE = "struct<id:bigint,body:string,system:boolean,author:struct<username:string,name:string>,created_at:timestamp,updated_at:timestamp,position:struct<new_path:string,old_path:string>>"
GITLAB = {
    "commits": "slug string, id string, title string, message string, author_name string, web_url string, authored_date timestamp, committed_date timestamp, diffs array<struct<new_path:string,old_path:string,renamed_file:boolean>>",
    "merge_requests": "slug string, iid bigint, title string, description string, web_url string, source_branch string, sha string, merge_commit_sha string, squash_commit_sha string, author struct<username:string,name:string>, "
    f"created_at timestamp, updated_at timestamp, commits array<struct<id:string>>, discussions array<struct<individual_note:boolean,notes:array<{_NOTE}>>>",
    "issues": f"slug string, iid bigint, title string, description string, web_url string, author struct<username:string,name:string>, created_at timestamp, updated_at timestamp, notes array<{_NOTE}>",
}


def raw(spark: SparkSession, nodes: str | DataFrame, kind: str, schema: str) -> DataFrame:
    """Nodes of a kind: from a folder with a folder of JSON lines for each, or from rows
    ``kind, value`` as the remote data source gives them."""
    if isinstance(nodes, DataFrame):
        return nodes.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("n")).select("n.*")
    return spark.read.schema(schema).json(f"{nodes}/{kind}")


def _refs(kind: str, values: Column) -> Column:
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.transform(some, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("").alias("instance")))


def _owned(instance: str, numbers: Column) -> Column:
    return F.transform(F.coalesce(numbers, F.array().cast("array<string>")), lambda v: X.scoped_ref("pr_number", v, F.lit(instance)))


def _written(text: Column, slug: Column, nested: bool) -> Column:
    body = F.coalesce(text, F.lit(""))
    found = X.merge_numbers(body, slug) if nested else X.numbers(body, slug)
    return F.concat(_refs("ticket_key", X.ticket_keys(body)), _refs("url", X.urls(body)), _refs("pr_number", found))


def _documents(rows: DataFrame, instance: str, kind: str, repo: Column, external: Column, title: Column, body: Column, author: Column, url: Column, created: Column, updated: Column, refs: list[Column]) -> DataFrame:
    source = F.lit(instance)
    columns = [
        X.doc_id(source, F.lit(kind), external).alias("doc_id"), source.alias("source"), F.lit(kind).alias("type"), repo.alias("repo_ref"),
        F.coalesce(title, F.lit("")).alias("title"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(author, F.lit("")).alias("author"), F.coalesce(url, F.lit("")).alias("url"),
        *X.both_times(created, updated), X.ref_set(F.concat(*refs)).alias("refs"),
    ]
    return rows.select(*columns).to(DOCUMENT_WITH_REFS)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _number(slug: Column, n: Column) -> Column:
    return F.concat(slug, F.lit("#"), n.cast("string"))


def _fragment(url: Column, prefix: str, number: Column) -> Column:
    """What a comment's address ends in, from its ``#`` on; without one, made of its number."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(#[^#]+)$", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit(f"#{prefix}"), number.cast("string")))


def github(spark: SparkSession, folder: str | DataFrame, instance: str = "github") -> DataFrame:
    c = F.col
    slug = c("slug")
    repo = F.concat(F.lit("github:"), slug)
    commits = raw(spark, folder, "commits", GITHUB["commits"])
    prs = raw(spark, folder, "prs", GITHUB["prs"])
    issues = raw(spark, folder, "issues", GITHUB["issues"])
    pr_key = F.concat(slug, F.lit("/pull/"), c("number").cast("string"))
    issue_key = F.concat(slug, F.lit("/issues/"), c("number").cast("string"))
    paths = F.flatten(F.transform("files", lambda f: F.array_compact(F.array(f["filename"], f["previous_filename"]))))

    def numbers(column: str) -> Column:
        return F.transform(F.coalesce(c(f"{column}.nodes"), F.array().cast("array<struct<number:bigint>>")), lambda n: _number(slug, n["number"]))

    parts = [
        _documents(commits, instance, "commit", repo, F.concat(slug, F.lit("/commit/"), c("oid")), c("messageHeadline"), c("message"), F.coalesce("author.user.login", "author.name"), c("url"), c("authoredDate"), c("committedDate"),
                   [_owned(instance, numbers("associatedPullRequests")), _refs("file_path", paths), _written(c("message"), slug, False)]),
        _documents(prs, instance, "pr", repo, pr_key, c("title"), c("body"), c("author.login"), c("url"), c("createdAt"), c("updatedAt"),
                   [_owned(instance, numbers("closingIssuesReferences")), _refs("commit_sha", c("commits.nodes.commit.oid")), _written(F.concat_ws("\n", "title", "body", "headRefName"), slug, False)]),
        _documents(issues, instance, "issue", repo, issue_key, c("title"), c("body"), c("author.login"), c("url"), c("createdAt"), c("updatedAt"), [_written(F.concat_ws("\n", "title", "body"), slug, False)]),
    ]
    reviews = prs.select("slug", "number", F.explode("reviews.nodes").alias("r"))
    own = _owned(instance, F.array(_number(slug, c("number"))))
    state = F.lower(F.replace(F.coalesce("r.state", F.lit("")), F.lit("_"), F.lit(" ")))
    parts.append(_documents(reviews, instance, "pr_review", repo, F.concat(pr_key, _fragment(c("r.url"), "pullrequestreview-", c("r.databaseId"))), F.concat(F.lit("Review on "), _number(slug, c("number")), F.when(state != "", F.concat(F.lit(" ("), state, F.lit(")"))).otherwise("")), c("r.body"), c("r.author.login"), c("r.url"), c("r.createdAt"), c("r.updatedAt"), [own, _written(c("r.body"), slug, False)]))
    comments = reviews.select("slug", "number", F.explode("r.comments.nodes").alias("m"))
    parts.append(_documents(comments, instance, "review_comment", repo, F.concat(pr_key, _fragment(c("m.url"), "discussion_r", c("m.databaseId"))), F.concat(F.lit("Review comment on "), _number(slug, c("number")), F.when(F.coalesce("m.path", F.lit("")) != "", F.concat(F.lit(": "), c("m.path"))).otherwise("")), c("m.body"), c("m.author.login"), c("m.url"), c("m.createdAt"), c("m.updatedAt"), [_refs("file_path", F.array("m.path")), own, _written(c("m.body"), slug, False)]))
    notes = issues.select("slug", "number", F.explode("comments.nodes").alias("m"))
    parts.append(_documents(notes, instance, "issue_comment", repo, F.concat(issue_key, _fragment(c("m.url"), "issuecomment-", c("m.databaseId"))), F.concat(F.lit("Comment on "), _number(slug, c("number"))), c("m.body"), c("m.author.login"), c("m.url"), c("m.createdAt"), c("m.updatedAt"), [own, _written(c("m.body"), slug, False)]))
    return _all(parts)


def gitlab(spark: SparkSession, folder: str | DataFrame, instance: str = "gitlab", base: str = "https://gitlab.com") -> DataFrame:
    c = F.col
    slug = c("slug")
    repo = F.concat(F.lit("gitlab:"), slug)
    commits = raw(spark, folder, "commits", GITLAB["commits"])
    merges = raw(spark, folder, "merge_requests", GITLAB["merge_requests"])
    issues = raw(spark, folder, "issues", GITLAB["issues"])

    def address(given: Column, path: str, key: Column) -> Column:
        return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(f"{base}/"), slug, F.lit(path), key.cast("string")))

    def person(column: str) -> Column:
        return F.coalesce(F.nullif(c(f"{column}.username"), F.lit("")), c(f"{column}.name"))

    changed = F.flatten(F.transform("diffs", lambda d: F.when(d["renamed_file"] & (d["old_path"] != d["new_path"]), F.array(d["new_path"], d["old_path"])).otherwise(F.array(d["new_path"]))))
    key = F.concat(slug, F.lit("/pull/"), c("iid").cast("string"))
    issue_key = F.concat(slug, F.lit("/issues/"), c("iid").cast("string"))
    merge_url, issue_url = address(c("web_url"), "/-/merge_requests/", c("iid")), address(c("web_url"), "/-/issues/", c("iid"))
    parts = [
        _documents(commits, instance, "commit", repo, F.concat(slug, F.lit("/commit/"), c("id")), c("title"), c("message"), c("author_name"), address(c("web_url"), "/-/commit/", c("id")), c("authored_date"), c("committed_date"), [_refs("file_path", changed), _written(c("message"), slug, True)]),
        _documents(merges, instance, "pr", repo, key, c("title"), c("description"), person("author"), merge_url, c("created_at"), c("updated_at"),
                   [_refs("commit_sha", F.concat(F.coalesce("commits.id", F.array().cast("array<string>")), F.array("sha", "merge_commit_sha", "squash_commit_sha"))), _written(F.concat_ws("\n", "title", "description", "source_branch"), slug, True)]),
        _documents(issues, instance, "issue", repo, issue_key, c("title"), c("description"), person("author"), issue_url, c("created_at"), c("updated_at"), [_written(F.concat_ws("\n", "title", "description"), slug, True)]),
    ]
    own = _owned(instance, F.array(_number(slug, c("iid"))))
    talks = merges.select("slug", "iid", merge_url.alias("at"), F.explode("discussions").alias("d"))
    said = talks.select("slug", "iid", "at", "d.individual_note", F.posexplode(F.filter("d.notes", lambda n: ~F.coalesce(n["system"], F.lit(False)))).alias("n", "m"))
    opens = (c("n") == 0) & ~F.coalesce("individual_note", F.lit(False))
    mark = F.concat(F.lit("#note_"), c("m.id").cast("string"))
    paths = _refs("file_path", F.array_distinct(F.array("m.position.new_path", "m.position.old_path")))
    label = F.concat(slug, F.lit("!"), c("iid").cast("string"))
    place = F.coalesce(F.nullif(c("m.position.new_path"), F.lit("")), c("m.position.old_path"), F.lit(""))
    tail = F.when(place != "", F.concat(F.lit(": "), place)).otherwise("")
    for kind, rows, title in (("pr_review", said.where(opens), "Review on "), ("review_comment", said.where(~opens), "Review comment on ")):
        parts.append(_documents(rows, instance, kind, repo, F.concat(key, mark), F.concat(F.lit(title), label, tail), c("m.body"), person("m.author"), F.concat("at", mark), c("m.created_at"), c("m.updated_at"), [paths, own, _written(c("m.body"), slug, True)]))
    notes = issues.select("slug", "iid", issue_url.alias("at"), F.explode(F.filter("notes", lambda n: ~F.coalesce(n["system"], F.lit(False)))).alias("m"))
    parts.append(_documents(notes, instance, "issue_comment", repo, F.concat(issue_key, mark), F.concat(F.lit("Comment on "), _number(slug, c("iid"))), c("m.body"), person("m.author"), F.concat("at", mark), c("m.created_at"), c("m.updated_at"), [own, _written(c("m.body"), slug, True)]))
    return _all(parts)


def units(documents: DataFrame) -> DataFrame:
    """Order of delivery: by time of change, then id."""
    return documents.orderBy("updated_at", "doc_id")
