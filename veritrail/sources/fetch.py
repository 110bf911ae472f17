"""Paged reading of the four sources over an injected transport.

A transport is a callable ``send(request) -> response`` (:class:`Request`, :class:`Response`), so
nothing here opens a connection: a deployment names a factory of its own, tests a recorded one.
Nodes come as the services give them, one JSON text each, for the normalisers in ``forge`` and
``trackers``. As a data source (``spark.read.format("remote")``) each pair of a repository and a
kind is a partition of its own, read by whichever executor takes it.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.store import BadRequest
from .changes import Transient, pages, retrying
from .trackers import jql

PAGE, BLOCK_DEPTH = 100, 8


@dataclass(frozen=True)
class Request:
    method: str
    path: str
    params: dict = field(default_factory=dict)
    body: dict | None = None


@dataclass(frozen=True)
class Response:
    status: int
    body: object = None
    headers: dict = field(default_factory=dict)


def wait_of(header: str | None, now: float) -> float | None:
    """Seconds to wait by a header that gives them or the date of the end; None if it says nothing
    that can be read."""
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except ValueError:
        return None


class Client:
    """Asks again after a 429, a 5xx or a broken connection, as :func:`retrying` does, and refuses
    any other answer that isn't a success."""

    def __init__(self, send: Callable[[Request], Response], attempts: int = 5, first: float = 1.0, most: float = 30.0, longest_wait: float = 120.0, sleep=time.sleep, now=time.time):
        self.send, self.sleep, self.now = send, sleep, now
        self.limits = {"attempts": attempts, "first": first, "most": most, "longest_wait": longest_wait}

    def ask(self, method: str, path: str, params: dict | None = None, body: dict | None = None) -> Response:
        def once() -> Response:
            try:
                found = self.send(Request(method, path, params or {}, body))
            except OSError as e:
                raise Transient(str(e)) from e
            if found.status == 429 or found.status >= 500:
                wait = {k.lower(): v for k, v in found.headers.items()}.get("retry-after")
                raise Transient(f"{path}: {found.status}", wait_of(wait, self.now()))
            if not 200 <= found.status < 300:
                raise BadRequest(f"{path}: {found.status}")
            return found

        return retrying(once, sleep=self.sleep, **self.limits)

    def get(self, path: str, **params) -> Response:
        return self.ask("GET", path, {k: v for k, v in params.items() if v is not None})


# -- a forge with a graph interface ---------------------------------------------------------

_WHO, _DATES = "author { login }", "createdAt updatedAt"
_COMMENT = f"databaseId body url {_WHO} {_DATES}"


def _connection(name: str, fields: str, arguments: str = "") -> str:
    return f"{name}(first: {PAGE}{arguments}) {{ pageInfo {{ hasNextPage endCursor }} nodes {{ {fields} }} }}"


_REVIEW = f"id databaseId state body url {_WHO} {_DATES} {_connection('comments', _COMMENT.replace('url', 'path url'))}"
_NEWEST = ", orderBy: {field: UPDATED_AT, direction: DESC}"
#: What is asked of each kind's nodes, and what its lists inside a node hold.
GRAPH = {
    "commits": ("oid url messageHeadline message committedDate authoredDate author { name user { login } } " + _connection("associatedPullRequests", "number"), {"associatedPullRequests": "number"}),
    "prs": (
        f"id number title body url {_DATES} headRefName {_WHO} {_connection('closingIssuesReferences', 'number')} {_connection('commits', 'commit { oid }')} {_connection('reviews', _REVIEW)}",
        {"closingIssuesReferences": "number", "commits": "commit { oid }", "reviews": _REVIEW},
    ),
    "issues": (f"id number title body url {_DATES} {_WHO} {_connection('comments', _COMMENT)}", {"comments": _COMMENT}),
}


def _graph(client: Client, query: str, variables: dict) -> dict:
    found = client.ask("POST", "/graphql", body={"query": query, "variables": variables}).body
    if found.get("errors"):
        raise BadRequest(json.dumps(found["errors"])[:500])
    return found["data"]


def _rest_of(client: Client, node: dict, kind: str, lists: dict[str, str]) -> dict:
    """Completes the lists of a node that have further pages, reviews' comments too."""
    for name, fields in lists.items():
        found = node.get(name)
        if not found:
            continue
        token = found["pageInfo"]["endCursor"] if found.get("pageInfo", {}).get("hasNextPage") else None
        while token:
            query = f"query($id: ID!, $after: String) {{ node(id: $id) {{ ... on {kind} {{ {_connection(name, fields, ', after: $after')} }} }} }}"
            more = _graph(client, query, {"id": node["id"], "after": token})["node"][name]
            found["nodes"] += more["nodes"]
            token = more["pageInfo"]["endCursor"] if more["pageInfo"]["hasNextPage"] else None
        if name == "reviews":
            for review in found["nodes"]:
                _rest_of(client, review, "PullRequestReview", {"comments": _COMMENT.replace("url", "path url")})
    return node


def graph_nodes(client: Client, slug: str, kind: str, fields: str, since: str | None = None, until: str | None = None) -> Iterator[dict]:
    """Bare nodes of a kind, newest first. Pages stop at the first node changed before ``since`` (ISO
    time; what was changed at that very time is read again); nodes changed after ``until`` are passed by."""
    owner, name = slug.split("/", 1)
    own = {"commits": "history", "prs": "pullRequests", "issues": "issues"}[kind]
    if kind == "commits":
        inner = "defaultBranchRef { target { ... on Commit { " + _connection("history", fields, ", after: $after, since: $since, until: $until") + " } } }"
    else:
        inner = _connection(own, fields, ", after: $after" + _NEWEST)
    declared = "$owner: String!, $name: String!, $after: String" + (", $since: GitTimestamp, $until: GitTimestamp" if kind == "commits" else "")
    query = f"query({declared}) {{ repository(owner: $owner, name: $name) {{ {inner} }} }}"

    def fetch(token: str | None):
        variables = {"owner": owner, "name": name, "after": token} | ({"since": since, "until": until} if kind == "commits" else {})
        found = _graph(client, query, variables)["repository"]
        if kind == "commits":
            found = (found.get("defaultBranchRef") or {}).get("target") or {}
        found = found.get(own) or {"nodes": [], "pageInfo": {}}
        return found["nodes"], found["pageInfo"]["endCursor"] if found["pageInfo"].get("hasNextPage") else None

    at = "committedDate" if kind == "commits" else "updatedAt"
    for node in pages(fetch):
        if since and node[at] < since:
            return
        if not until or node[at] <= until:
            yield node


def github(client: Client, slug: str, kind: str, since: str | None = None, until: str | None = None, details: bool = True) -> Iterator[dict]:
    """Nodes of a kind, newest first, with all of their lists; commits bring their file lists."""
    for node in graph_nodes(client, slug, kind, GRAPH[kind][0], since, until):
        yield (github_details(client, slug, kind, node) if details else node) | {"slug": slug}


def github_details(client: Client, slug: str, kind: str, node: dict) -> dict:
    if kind == "commits":
        return node | {"files": commit_files(client, slug, node["oid"])}
    return _rest_of(client, node, "PullRequest" if kind == "prs" else "Issue", GRAPH[kind][1])


def commit_files(client: Client, slug: str, oid: str) -> list[dict]:
    """The files of a commit, renamed ones with their earlier names."""
    out, page = [], 1
    while True:
        files = client.get(f"/repos/{slug}/commits/{oid}", per_page=PAGE, page=page).body.get("files") or []
        out += [{"filename": f["filename"], "previous_filename": f.get("previous_filename")} for f in files]
        if len(files) < PAGE:
            return out
        page += 1


# -- a forge with numbered pages ------------------------------------------------------------


def numbered_pages(client: Client, path: str, **params) -> Iterator[dict]:
    """All items; the header names the next page, and where a service leaves it out, a full page
    means that there is another one."""
    page = 1
    while page:
        found = client.get(path, **params, per_page=PAGE, page=page)
        yield from found.body
        headers = {k.lower(): v for k, v in found.headers.items()}
        if "x-next-page" in headers:
            text = str(headers["x-next-page"]).strip()
            following = int(text) if text.isdigit() else 0
            page = following if following > page else 0
        else:
            page = page + 1 if len(found.body) >= PAGE else 0


def gitlab(client: Client, slug: str, kind: str, since: str | None = None, until: str | None = None, details: bool = True) -> Iterator[dict]:
    """Commits with their diffs, merge requests with commits and discussions, issues with notes."""
    base = f"/projects/{slug.replace('/', '%2F')}"
    if kind == "commits":
        listed = numbered_pages(client, f"{base}/repository/commits", since=since, until=until)
    else:
        listed = numbered_pages(client, f"{base}/{kind}", updated_after=since, updated_before=until, order_by="updated_at", sort="asc", scope="all")
    for node in listed:
        yield (gitlab_details(client, slug, kind, node) if details else node) | {"slug": slug}


def gitlab_details(client: Client, slug: str, kind: str, node: dict) -> dict:
    base = f"/projects/{slug.replace('/', '%2F')}"
    if kind == "commits":
        return node | {"diffs": list(numbered_pages(client, f"{base}/repository/commits/{node['id']}/diff"))}
    own = f"{base}/{kind}/{node['iid']}"
    if kind == "merge_requests":
        return node | {"commits": list(numbered_pages(client, f"{own}/commits")), "discussions": list(numbered_pages(client, f"{own}/discussions"))}
    return node | {"notes": list(numbered_pages(client, f"{own}/notes", sort="asc"))}


# -- a tracker with tokens and offsets ------------------------------------------------------


def jira(client: Client, projects: list[str], watermark: datetime | None = None, details: bool = True) -> Iterator[dict]:
    """Tickets oldest change first, each with all its comments, as ``trackers.jira`` takes them.
    A day more than asked comes; :class:`veritrail.sources.follow.Follow` tests exactly."""

    def fetch(token: str | None):
        found = client.get("/rest/api/3/search/jql", jql=jql(projects, watermark), fields="summary,description,created,updated,reporter", maxResults=PAGE, nextPageToken=token).body
        return found["issues"], None if found.get("isLast") else found.get("nextPageToken")

    as_text = lambda tree: None if tree is None else json.dumps(tree)
    who = lambda x: (x or {}).get("displayName")
    for issue in pages(fetch):
        f = issue["fields"]
        node = {"key": issue["key"], "summary": f.get("summary"), "description": as_text(f.get("description")), "reporter": who(f.get("reporter")), "created": f.get("created"), "updated": f.get("updated")}
        yield jira_details(client, node) if details else node


def jira_details(client: Client, node: dict) -> dict:
    as_text = lambda tree: None if tree is None else json.dumps(tree)
    said = [
        {"id": str(c["id"]), "body": as_text(c.get("body")), "author": (c.get("author") or {}).get("displayName"), "created": c.get("created"), "updated": c.get("updated")}
        for c in jira_comments(client, node["key"])
    ]
    return node | {"comments": said}


def jira_comments(client: Client, key: str) -> list[dict]:
    """By offset; the service may give fewer than asked, so the next offset is what has come."""
    out: list[dict] = []
    while True:
        found = client.get(f"/rest/api/3/issue/{key}/comment", startAt=len(out), maxResults=PAGE, orderBy="created").body
        out += found["comments"]
        if not found["comments"] or len(out) >= found["total"]:
            return out


# -- a wiki with cursors and nested blocks --------------------------------------------------


def _listed(client: Client, method: str, path: str, body: dict | None = None) -> Iterator[dict]:
    def fetch(token: str | None):
        if method == "POST":
            found = client.ask("POST", path, body=(body or {}) | {"page_size": PAGE} | ({"start_cursor": token} if token else {})).body
        else:
            found = client.get(path, page_size=PAGE, start_cursor=token).body
        following = found.get("next_cursor") if found.get("has_more") else None
        if found.get("has_more") and (not following or following == token):
            raise BadRequest(f"{path}: a further page without a cursor of its own")
        return found["results"], following

    return pages(fetch)


def notion(client: Client, details: bool = True) -> Iterator[dict]:
    """Pages, oldest edit first, with their whole relations and block trees, as ``trackers.notion``
    takes them."""
    body = {"filter": {"property": "object", "value": "page"}, "sort": {"timestamp": "last_edited_time", "direction": "ascending"}}
    for page in _listed(client, "POST", "/v1/search", body):
        yield notion_details(client, page) if details else page


def notion_details(client: Client, page: dict) -> dict:
    properties = {name: relation(client, page["id"], p) for name, p in (page.get("properties") or {}).items()}
    return page | {"properties": json.dumps(properties), "blocks": json.dumps(block_tree(client, page["id"]))}


def relation(client: Client, page: str, prop: dict) -> dict:
    """A property; of a relation that was cut short, all of it."""
    if prop.get("type") != "relation" or not prop.get("has_more"):
        return prop
    every = [{"id": r["relation"]["id"]} for r in _listed(client, "GET", f"/v1/pages/{page}/properties/{prop['id']}")]
    return prop | {"relation": every, "has_more": False}


def block_tree(client: Client, parent: str, depth: int = 1) -> list[dict]:
    """Blocks with their children, BLOCK_DEPTH levels at most; pages inside pages stay apart."""
    blocks = list(_listed(client, "GET", f"/v1/blocks/{parent}/children"))
    if depth < BLOCK_DEPTH:
        for b in blocks:
            if b.get("has_children") and b.get("type") != "child_page":
                b["children"] = block_tree(client, b["id"], depth + 1)
    return blocks


# -- as a data source -----------------------------------------------------------------------

KINDS = {"github": ("commits", "prs", "issues"), "gitlab": ("commits", "merge_requests", "issues"), "jira": ("tickets",), "notion": ("pages",)}


def nodes(client: Client, source: str, kind: str, slug: str, since: str | None, until: str | None = None, details: bool = True) -> Iterator[dict]:
    if source == "github":
        return github(client, slug, kind, since, until, details)
    if source == "gitlab":
        return gitlab(client, slug, kind, since, until, details)
    if source == "jira":
        return jira(client, [slug] if slug else [], datetime.fromisoformat(since.replace("Z", "+00:00")) if since else None, details)
    return notion(client, details)


def with_details(client: Client, source: str, kind: str, node: dict) -> dict:
    """A bare node with what further requests tell of it."""
    if source == "github":
        return github_details(client, node["slug"], kind, node)
    if source == "gitlab":
        return gitlab_details(client, node["slug"], kind, node)
    return jira_details(client, node) if source == "jira" else notion_details(client, node)


def connected(options: dict, most_a_second: float | None = None) -> Client:
    """A client over the transport that ``options`` name, at most so many requests a second."""
    module, factory = options["transport"].split(":")
    send = getattr(importlib.import_module(module), factory)(options)
    if most_a_second:
        send = Paced(send, most_a_second)
    return Client(send)


class Paced:
    """A transport with a least time between the starts of two requests."""

    def __init__(self, send: Callable[[Request], Response], most_a_second: float, sleep=time.sleep, clock=time.monotonic):
        self.send, self.gap, self.sleep, self.clock, self.next = send, 1.0 / most_a_second, sleep, clock, 0.0

    def __call__(self, request: Request) -> Response:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
        return self.send(request)


def detailed(listed: DataFrame, options: dict, tasks: int, a_second: float | None = None) -> DataFrame:
    """Bare nodes (``kind, value``, read with the option ``details`` false) with their details: the
    nodes are dealt to ``tasks``, which share a budget of ``a_second`` requests, so one repository's
    many commits, or one wiki's many block trees, are read by many tasks, and a lost task asks
    for its own nodes alone again."""
    source = options["source"]

    def run(frames):
        client = connected(options, a_second and a_second / tasks)
        for frame in frames:
            made = [json.dumps(with_details(client, source, kind, json.loads(value))) for kind, value in zip(frame["kind"], frame["value"])]
            yield pd.DataFrame({"kind": frame["kind"], "value": made})

    dealt = listed.select("kind", "value").repartition(tasks, F.xxhash64("value"))
    return dealt.mapInPandas(run, "kind string, value string")


class Remote(DataSource):
    """Options: ``source`` (github, gitlab, jira, notion), ``transport`` ("module:factory"; the
    factory gets all options and returns ``send``), ``slugs`` (repositories or projects, comma
    between; none for a wiki), ``since`` (ISO time), ``details`` ("false" leaves out what needs
    requests for each node, see :func:`detailed`). Rows are ``kind, value`` with a node's JSON.
    As a stream it follows what changes, see :mod:`veritrail.sources.follow`."""

    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return "kind string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _RemoteReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        from .follow import Follow

        return Follow(dict(self.options))


class _RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        if options.get("source") not in KINDS or ":" not in options.get("transport", ""):
            raise BadRequest("a remote source has a known name and a transport")

    def partitions(self):
        slugs = [s for s in self.options.get("slugs", "").split(",") if s] or [""]
        return [InputPartition((slug, kind)) for slug in slugs for kind in KINDS[self.options["source"]]]

    def read(self, partition):
        slug, kind = partition.value
        whole = self.options.get("details", "true") != "false"
        for node in nodes(connected(self.options), self.options["source"], kind, slug, self.options.get("since"), details=whole):
            yield kind, json.dumps(node)
