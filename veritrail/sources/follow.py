"""Following the four sources: a stream whose offset says how far each list has been read.

``spark.readStream.format("remote")`` has an offset for each pair of a repository and a kind: the
time of its newest change and a digest of what changed at that time. The driver asks for the
newest changes alone; a batch is a partition for each list that has moved, read on executors
from the old mark to the new one, both ends included. So several changes of one time are never
torn apart: if another one of the mark's own time turns up later the digest differs, and that
time is read again. What comes twice is the same document, which the store takes idempotently.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..operators.store import BadRequest
from .fetch import KINDS, PAGE, Client, _listed, connected, graph_nodes, nodes, numbered_pages, with_details
from .trackers import jql

#: The time and the id of a node, by source and kind (fixed values).
MARKS = {
    ("github", "commits"): ("committedDate", "oid"),
    ("github", "prs"): ("updatedAt", "number"),
    ("github", "issues"): ("updatedAt", "number"),
    ("gitlab", "commits"): ("committed_date", "id"),
    ("gitlab", "merge_requests"): ("updated_at", "iid"),
    ("gitlab", "issues"): ("updated_at", "iid"),
    ("jira", "tickets"): ("updated", "key"),
    ("notion", "pages"): ("last_edited_time", "id"),
}


def instant(text: str) -> datetime:
    """A service's time as UTC; one without a zone is taken as UTC."""
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def written(at: datetime) -> str:
    """As services take it; a fraction of a second only where there is one."""
    return at.strftime("%Y-%m-%dT%H:%M:%S" + (".%f" if at.microsecond else "")) + "Z"


def newest_first(client: Client, source: str, kind: str, slug: str) -> Iterator[dict]:
    """Times and ids of a list, the newest first, without anything else of its nodes."""
    if source == "github":
        yield from graph_nodes(client, slug, kind, " ".join(MARKS[source, kind]))
    elif source == "gitlab":
        base = f"/projects/{slug.replace('/', '%2F')}"
        if kind == "commits":
            yield from numbered_pages(client, f"{base}/repository/commits")
        else:
            yield from numbered_pages(client, f"{base}/{kind}", order_by="updated_at", sort="desc", scope="all")
    elif source == "jira":
        order = jql([slug] if slug else [], None).replace("ORDER BY updated ASC", "ORDER BY updated DESC")
        token = None
        while True:
            found = client.get("/rest/api/3/search/jql", jql=order, fields="updated", maxResults=PAGE, nextPageToken=token).body
            yield from ({"key": i["key"], "updated": i["fields"]["updated"]} for i in found["issues"])
            token = None if found.get("isLast") else found.get("nextPageToken")
            if not token:
                return
    else:
        body = {"filter": {"property": "object", "value": "page"}, "sort": {"timestamp": "last_edited_time", "direction": "descending"}}
        yield from _listed(client, "POST", "/v1/search", body)


def mark(client: Client, source: str, kind: str, slug: str) -> dict | None:
    """The newest time of a list and a digest of the ids of that time; None for an empty list.
    Reading stops at the first older node, so it takes one page unless very many share a time."""
    at, key = MARKS[source, kind]
    newest, ids = None, []
    for node in newest_first(client, source, kind, slug):
        time = instant(node[at])
        if newest is not None and time < newest:
            break
        if newest is None or time > newest:
            newest, ids = time, []
        ids.append(str(node[key]))
    if newest is None:
        return None
    return {"at": written(newest), "ids": hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()[:16]}


def between(client: Client, source: str, kind: str, slug: str, start: str | None, end: str) -> Iterator[dict]:
    """Nodes from one time to another, both included, with their details. Services that take a
    coarser bound, or none, give more, which is left out here by the exact time."""
    at, _ = MARKS[source, kind]
    low, high = instant(start) if start else None, instant(end)
    whole = source == "github"  # it leaves out by itself before it asks for details
    for node in nodes(client, source, kind, slug, start, end if source in ("github", "gitlab") else None, details=whole):
        time = instant(node[at])
        if (low is None or time >= low) and time <= high:
            yield node if whole else with_details(client, source, kind, node)


class Follow(DataSourceStreamReader):
    """Offsets are ``{"slug kind": {"at": time, "ids": digest}}``. ``since`` is where a stream
    without a checkpoint starts, such as the cursor of a store (:meth:`Sync.cursor`)."""

    def __init__(self, options: dict):
        self.options = options
        if options.get("source") not in KINDS or ":" not in options.get("transport", ""):
            raise BadRequest("a remote source has a known name and a transport")
        self.source = options["source"]
        self.slugs = [s for s in options.get("slugs", "").split(",") if s] or [""]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        client, found = connected(self.options), {}
        for slug in self.slugs:
            for kind in KINDS[self.source]:
                newest = mark(client, self.source, kind, slug)
                if newest:
                    found[f"{slug} {kind}"] = newest
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One for each list that has moved. A list whose newest node was deleted has an older mark
        than before; there is nothing to read in it."""
        out = []
        for name, to in sorted(end.items()):
            since = start.get(name, {}).get("at") or self.options.get("since")
            if start.get(name) != to and (not since or instant(to["at"]) >= instant(since)):
                out.append(InputPartition(json.dumps([*name.rsplit(" ", 1), since, to["at"]])))
        return out

    def read(self, partition):
        slug, kind, since, until = json.loads(partition.value)
        for node in between(connected(self.options), self.source, kind, slug, since, until):
            yield kind, json.dumps(node)
