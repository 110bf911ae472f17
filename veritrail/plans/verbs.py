"""The query verbs: find_decision, why, trace, impact_of, history_of, status.

An :class:`Engine` holds the stored tables; each verb returns an :class:`Answer` of flat
tables, and :func:`bundle` makes one nested row of them. Decisions that need a value on the
driver (the event's window, the one document a reference means) read a few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.embedding import hashed
from ..operators import chains as C
from ..operators import graph as G
from ..operators import link as L
from ..operators import rank as R
from ..operators import search as S
from ..operators import store
from ..schema import BODY_CHARACTERS, EVENT_CANDIDATES, EVENT_WINDOW_DAYS, EXCERPT_BYTES, HISTORY_CAP, HISTORY_DEFAULT, PASSAGES, TOP_K, TRACE_DEPTH, WALK_DEPTH
from ..session import new_folder, settled


#: What is searched for after a document if nothing is asked, before its title (fixed value: it decides what is found).
FOLLOW_UPS = "consequences, follow-ups, incidents related to "


@dataclass(frozen=True)
class Window_:
    since: datetime
    until: datetime
    derivation: str
    anchored_by: str | None = None


@dataclass
class Answer:
    nodes: DataFrame
    chains: DataFrame
    gaps: DataFrame
    anchor: dict = field(default_factory=dict)


@dataclass
class Engine:
    spark: SparkSession
    documents: DataFrame
    chunks: DataFrame
    edges: DataFrame
    model: object = hashed
    width: int = 8
    top_k: int = TOP_K
    depth: int = WALK_DEPTH
    window_days: int = EVENT_WINDOW_DAYS
    #: Gives the index when a verb searches; without it one is written.
    opened: Callable[[], S.Index] | None = None
    _index: S.Index | None = None

    @property
    def index(self) -> S.Index:
        """Opened or written by the first verb that searches, once for all verbs of this engine."""
        if self._index is None:
            self._index = self.opened() if self.opened else S.write_index(self.chunks, new_folder(self.spark, "index"))
        return self._index

    # -- parts ---------------------------------------------------------------------------

    def _query(self, text: str) -> DataFrame:
        vector = [float(x) for x in self.model([text])[0]]
        return self.spark.createDataFrame([(1, text, vector)], "query_id int, text string, embedding array<float>")

    def retrieve(self, text: str, where: S.Filters | None = None, k: int | None = None) -> DataFrame:
        return settled(S.lift(S.hybrid(self.index, self._query(text), k or self.top_k, where), self.index.texts, self.documents))

    def resolve_event(self, text: str) -> tuple[Window_ | None, list[str]]:
        """A date gives a window around it; a description, the window around the earliest of
        the best documents if they lie close together; else a gap, and no window."""
        half = timedelta(days=self.window_days)
        probe = self.spark.range(1).select(X.event_date(F.lit(text)).alias("t")).first().t
        if probe is not None:
            return Window_(probe - half, probe + half, "date"), []
        found = self.retrieve(text).orderBy("position").limit(EVENT_CANDIDATES)
        row = found.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.min_by("doc_id", F.struct("created_at", "position")).alias("doc")).first()
        if row.a is None:
            return None, [f"no document matches the event {text!r}; the search is not bounded in time"]
        if row.b - row.a > 2 * half:
            return None, [f"documents that match the event {text!r} are too far apart in time; the search is not bounded in time"]
        return Window_(row.a - half, row.a + half, "documents", row.doc), []

    def _excerpt(self, body: str | None) -> str:
        """The first bytes of a body, as a search takes them."""
        return self.spark.range(1).select(X.byte_excerpt(F.lit(body or ""), EXCERPT_BYTES).alias("t")).first().t

    def _seeds(self, lifted: DataFrame) -> DataFrame:
        return lifted.select("query_id", F.col("doc_id").alias("node"), "position")

    def _finish(self, nodes: DataFrame, paths: DataFrame, seeds: DataFrame, extra: list[str], anchor: dict, by_time: bool) -> Answer:
        ranked = settled(R.by_time(nodes) if by_time else R.by_rank(nodes))
        chains = C.chain_table(paths, ranked, G.seed_links(self.edges, seeds))
        any_edge = not self.edges.isEmpty()
        found = C.gaps(ranked, chains, any_edge)
        if extra:
            told = self.spark.createDataFrame([(1, -i, m) for i, m in enumerate(reversed(extra))], "query_id int, position bigint, message string")
            found = told.unionByName(found)
        return Answer(ranked, chains, found, anchor)

    # -- verbs ---------------------------------------------------------------------------

    def find_decision(self, question: str, around: str | None = None, where: S.Filters | None = None, now: datetime | None = None) -> Answer:
        """Seeds by fused search, others by the walk; scored with distance and a time prior."""
        question = question.strip()
        if not question:
            raise store.BadRequest("a question is needed")
        now = now or datetime.now(timezone.utc)
        window, extra = self.resolve_event(around) if around else (None, [])
        bounds = where or S.Filters()
        if window:
            bounds = bounds.within(window.since, window.until)
        hits = R.scaled(self.retrieve(question, bounds))
        seeds = self._seeds(hits)
        paths = G.walk(self.edges, seeds, self.depth, admitted=G.admitted(self.documents))
        prior = (lambda c: R.window_prior(c, F.lit(window.since), F.lit(window.until))) if window else (lambda c: R.recency_prior(c, now))
        first = hits.select("query_id", F.col("doc_id").alias("node"), "position", F.lit("seed").alias("role"), (F.col("scaled") * prior(F.col("created_at"))).alias("score"), F.lit(0).alias("hops"), "excerpt")
        of_seed = hits.select("query_id", F.col("doc_id").alias("seed"), "scaled")
        dates = self.documents.select(F.col("doc_id").alias("node"), F.col("created_at").alias("_c"))
        walked = paths.where("hops > 0").join(of_seed, ["query_id", "seed"]).join(dates, "node")
        second = walked.select("query_id", "node", F.col("hops").alias("position"), F.lit(None).cast("string").alias("role"), R.walked_score(F.col("hops"), F.col("confidence"), F.col("scaled"), prior(F.col("_c"))).alias("score"), "hops", F.lit(None).cast("string").alias("excerpt"))
        nodes = R.node_set([first, second], self.documents)
        return self._finish(nodes, paths, seeds, extra, {"kind": "question", "query": question, "window": window}, by_time=False)

    def _anchored(self, seeds: DataFrame, roles: str, depth: int, after: datetime | None, matches: DataFrame | None, direction: str = "both", walked_role: str | None = None, by_time: bool = True, extra=(), anchor=None) -> Answer:
        paths = G.walk(self.edges, seeds, depth, direction, admitted=G.admitted(self.documents, after))
        first = seeds.select("query_id", "node", F.col("position").cast("bigint").alias("position"), F.lit(roles).alias("role"), F.lit(1.0).alias("score"), F.lit(0).alias("hops"))
        second = paths.where("hops > 0").select("query_id", "node", F.col("hops").alias("position"), F.lit(walked_role).cast("string").alias("role"), R.walked_score(F.col("hops"), F.col("confidence")).alias("score"), "hops")
        stages = [first, second]
        if matches is not None:
            third = R.scaled(matches).select("query_id", F.col("doc_id").alias("node"), "position", F.lit("semantic_match").alias("role"), F.col("scaled").alias("score"), F.lit(None).cast("int").alias("hops"))
            stages.append(third)
        return self._finish(R.node_set(stages, self.documents), paths, seeds, list(extra), anchor or {}, by_time)

    def trace(self, ref: str, direction: str = "both", depth: int = TRACE_DEPTH, focus: str | None = None) -> Answer:
        """The neighbourhood of one document in order of time, with its body or the passages
        that fit ``focus``."""
        if not 1 <= depth <= TRACE_DEPTH:
            raise store.BadRequest(f"depth is 1 to {TRACE_DEPTH}")
        doc, extra = L.resolve_one(ref, self.documents), []
        seeds = self.spark.createDataFrame([(1, doc.doc_id, 1)], "query_id int, node string, position bigint")
        excerpt = None
        if focus:
            excerpt = self.focus(doc.doc_id, focus)
            if excerpt is None:
                extra.append(f"no passage of {doc.doc_id} fits {focus!r}; the body is shown")
        if excerpt is None:
            excerpt = self.spark.range(1).select(X.capped(F.lit(doc.body or ""), BODY_CHARACTERS).alias("t")).first().t
        return self._anchored(seeds, "seed", depth, None, None, direction, extra=extra, anchor={"kind": "document", "doc_id": doc.doc_id, "excerpt": excerpt})

    def focus(self, doc_id: str, text: str) -> str | None:
        """The best passages of a document for a text, in page order; null if none fits."""
        found = S.hybrid(self.index, self._query(text), PASSAGES, S.Filters(doc_id=doc_id)).orderBy("position").limit(PASSAGES)
        row = passages(F.broadcast(found), self.index.texts).first()  # at most PASSAGES rows; no text is shuffled
        return row and self.spark.range(1).select(X.capped(F.lit(row.text)).alias("t")).first().t

    def impact_of(self, ref_or_query: str, question: str | None = None) -> Answer:
        """What came after a document: later documents that are linked, and later ones that a
        search finds, in order of time."""
        try:
            doc_id = L.resolve_one(ref_or_query, self.documents).doc_id
        except store.Unciteable:
            raise
        except store.NotFound:
            best = self.retrieve(ref_or_query).orderBy("position").limit(1).collect()
            if not best:
                raise
            doc_id = best[0].doc_id
        doc = self.documents.where(F.col("doc_id") == doc_id).select("doc_id", "title", "created_at", "body").first()
        after = doc.created_at
        asked = (question or "").strip() or FOLLOW_UPS + (doc.title or "")
        text = "\n\n".join(filter(None, [asked, self._excerpt(doc.body)]))
        matches = self.retrieve(text, S.Filters(since=after)).where(F.col("created_at") > F.lit(after))
        seeds = self.spark.createDataFrame([(1, doc_id, 1)], "query_id int, node string, position bigint")
        answer = self._anchored(seeds, "seed", self.depth, after, matches, walked_role="follow_up", anchor={"kind": "document", "doc_id": doc_id})
        alone = answer.nodes.limit(2).count() == 1
        if alone:
            told = self.spark.createDataFrame([(1, 0, f"nothing after {doc_id} refers to it")], "query_id int, position bigint, message string")
            answer = replace(answer, gaps=told.unionByName(answer.gaps))
        return answer

    def commits_for(self, shas: DataFrame) -> DataFrame:
        """``position, sha, doc_id`` for hashes (position, sha); doc_id null if not indexed."""
        commits = self.documents.where("type = 'commit'").select("doc_id", X.sha_prefix(F.col("doc_id"), F.col("type")).alias("prefix"))
        return shas.withColumn("prefix", F.lower(X.short_sha(F.col("sha")))).join(commits, "prefix", "left").select("position", "sha", "doc_id")

    def _missing(self, found: DataFrame) -> list[str]:
        lost = found.where("doc_id is null").orderBy("position").collect()  # commits of one span or page
        return [f"commit {r.sha[:12]} is not in the index; sync its repository" for r in lost]

    def why(self, blame: DataFrame, code: str, question: str | None = None) -> Answer:
        """From blamed spans (sha, line_start, line_end, lines, subject) to what led to them."""
        grouped = blame_groups(blame)
        found = self.commits_for(grouped).where("sha is not null")
        subjects = [r.subject for r in grouped.orderBy("position").collect() if r.subject]
        query = "\n".join([question or "", self._excerpt(code), *subjects]).strip()
        seeds = found.where("doc_id is not null").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"), F.col("position").cast("bigint").alias("position"))
        return self._anchored(seeds, "blamed_commit", self.depth, None, self.retrieve(query), by_time=False, extra=self._missing(found), anchor={"kind": "code", "query": question})

    def history_of(self, log: DataFrame, limit: int = HISTORY_DEFAULT, before: str | None = None) -> Answer:
        """A path's commits (position, sha, author, time, subject), newest first, with what they
        link to; ``before`` is the prefix of one hash, after which the page starts."""
        page = history_page(log, limit, before)
        found = self.commits_for(page.select("position", "sha"))
        seeds = found.where("doc_id is not null").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"), F.col("position").cast("bigint").alias("position"))
        return self._anchored(seeds, "seed", 1, None, None, extra=self._missing(found), anchor={"kind": "path"})

    def status(self, cursors: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        return store.counts(self.documents, self.chunks, self.edges), store.source_status(self.documents, cursors, declared)


def passages(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, doc_id, text``: chosen chunks in page order, a blank line between, and an
    ellipsis where ordinals aren't adjacent."""
    rows = found.select("query_id", "doc_id", "ordinal").join(chunks.select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"])
    order = Window.partitionBy("query_id", "doc_id").orderBy("ordinal")
    jump = F.col("ordinal") - F.lag("ordinal").over(order) > 1
    part = F.when(jump, F.concat(F.lit("…\n\n"), F.col("text"))).otherwise(F.col("text"))
    parts = rows.select("query_id", "doc_id", "ordinal", part.alias("part"))
    listed = parts.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "part"))).alias("p"))
    return listed.select("query_id", "doc_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))


def blame_groups(blame: DataFrame) -> DataFrame:
    """One row for each hash in order of first sight, its lines together."""
    rows = blame.groupBy("sha").agg(
        F.min("line_start").alias("first"), F.max("subject").alias("subject"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "lines"))), lambda x: x["lines"])).alias("lines"),
    )
    return R.numbered(rows, [F.asc("first"), F.asc("sha")], name="position").drop("first")


def history_page(log: DataFrame, limit: int = HISTORY_DEFAULT, before: str | None = None) -> DataFrame:
    limit = min(limit or HISTORY_DEFAULT, HISTORY_CAP)
    after = 0
    if before:
        hits = log.where(F.col("sha").startswith(before)).select("position").limit(2).collect()
        if len(hits) != 1:
            raise store.BadRequest(f"{before!r} is the prefix of {'no' if not hits else 'more than one'} commit of this path")
        after = hits[0].position
    return log.where(F.col("position") > after).orderBy("position").limit(limit)


def bundle(answer: Answer, question: str) -> DataFrame:
    """One nested row: question, nodes by rank, chains, gaps."""
    nodes = answer.nodes.agg(F.sort_array(F.collect_list(F.struct("rank", "node", "role", F.round("score", 9).alias("score"), "title", "url"))).alias("nodes"))
    chains = answer.chains.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chain"))), lambda x: x["chain"]).alias("chains"))
    gaps = answer.gaps.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "message"))), lambda x: x["message"]).alias("gaps"))
    return nodes.join(F.broadcast(chains)).join(F.broadcast(gaps)).select(F.lit(question).alias("question"), "nodes", "chains", "gaps")


def bundle_json(answer: Answer, question: str) -> DataFrame:
    row = bundle(answer, question)
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))


def timeline(answer: Answer) -> DataFrame:
    """One line of text for each node in order of time."""
    line = F.concat_ws("  ", F.date_format("created_at", "yyyy-MM-dd"), "role", "title", "url")
    return R.by_time(answer.nodes).select("rank", line.alias("line"))
