"""Resolution of references to documents and the edges that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import PATH_COMMITS, REF_KINDS
from ..session import settled
from .store import BadRequest, NotFound, Tables, Unciteable, add_pending, remove_pending, upsert_edges

#: Target types that a kind of reference admits; others admit all (fixed values).
TARGET_TYPES = {"commit_sha": ("commit",), "pr_number": ("pr", "issue"), "ticket_key": ("ticket", "issue")}
#: Edge kind and confidence by kind of reference (fixed values).
RULES = {
    "url": ("references_doc", 1.0),
    "commit_sha": ("mentions_commit", 0.9),
    "ticket_key": ("references_doc", 0.9),
    "pr_number": ("references_doc", 0.9),
    "file_path": ("mentions_path", 0.7),
}
COMMIT_IN_PR, PR_CLOSES_ISSUE, SUPERSEDES = ("commit_in_pr", 1.0), ("pr_closes_issue", 1.0), ("supersedes", 0.8)

REFERENCE = ["src_doc", "kind", "value", "instance"]
#: Parts that a path's commits are thinned in first.
SALTS = 16
#: Documents that the message about an ambiguous reference names.
NAMED = 20

TICKET_SHAPE = r"^[A-Z][A-Z0-9]+-[0-9]+$"
NUMBER_SHAPE = r"^(?:([A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*))?#?([0-9]+)$"
SHA_SHAPE = r"^[0-9a-fA-F]{7,40}$"


def shapes(ref: Column) -> Column:
    """How a reference may be looked up, several at once: an array of (shape, key)."""

    def shape(name: str, test: Column, key: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("shape"), key.alias("key")))

    web = ref.rlike("^https?://")
    slug, number = F.regexp_extract(ref, NUMBER_SHAPE, 1), F.regexp_extract(ref, NUMBER_SHAPE, 2)
    numbered = number != ""
    lower = F.lower(ref)
    return F.array_compact(
        F.array(
            shape("url", web, ref),
            shape("page", web & X.page_key(ref).isNotNull(), X.page_key(ref)),
            shape("doc_id", ref.rlike("^[^:]+:[^:]+:.") & ~web, ref),
            shape("sha", ref.rlike(SHA_SHAPE), F.substring(lower, 1, 12)),
            shape("key", ref.rlike(TICKET_SHAPE), ref),
            shape("key", numbered & (slug != ""), F.concat(slug, F.lit("/pull/"), number)),
            shape("key", numbered & (slug != ""), F.concat(slug, F.lit("/issues/"), number)),
            shape("number", numbered & (slug == ""), number),
        )
    )


def lookup_keys(documents: DataFrame) -> DataFrame:
    """``doc_id, shape, key``: every way to name a document, so that all lookups are one
    equi-join. A hash is listed under each prefix of 7 to 12 digits, a page address under its
    page id, and a pull request or issue under its bare number."""
    key, kind = X.external_id(F.col("doc_id")), F.col("type")
    sha = X.sha_prefix(F.col("doc_id"), kind)
    tail = F.regexp_extract(key, r"/(?:pull|issues)/([0-9]+)$", 1)

    def row(name: str, test: Column, value: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("shape"), value.alias("key")))

    address = F.coalesce(F.col("url"), F.lit(""))
    fixed = F.array_compact(
        F.array(
            row("url", address != "", address),
            row("page", X.page_key(address).isNotNull(), X.page_key(address)),
            row("doc_id", F.lit(True), F.col("doc_id")),
            row("key", key != "", key),
            row("number", kind.isin("pr", "issue") & (tail != ""), tail),
        )
    )
    lengths = F.when(sha != "", F.sequence(F.lit(7), F.length(sha))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(lengths, lambda n: F.struct(F.lit("sha").alias("shape"), F.substr(sha, F.lit(1), n).alias("key")))
    return documents.select("doc_id", "source", "type", F.explode(F.concat(fixed, prefixes)).alias("k")).select("doc_id", "source", "type", "k.shape", "k.key")


def resolve(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """``ref, doc_id, source, type`` for each document that a reference string may mean."""
    asked = refs.select("ref").distinct().select("ref", F.explode(shapes(F.col("ref"))).alias("k")).select("ref", "k.shape", "k.key")
    return asked.join(lookup_keys(documents), ["shape", "key"]).select("ref", "doc_id", "source", "type").distinct()


def resolve_one(ref: str, documents: DataFrame):
    """The one document that a reference means."""
    spark = documents.sparkSession
    found = resolve(spark.createDataFrame([(ref,)], "ref string"), documents).select("doc_id").distinct()
    ids = [r.doc_id for r in found.orderBy("doc_id").limit(NAMED + 1).collect()]
    if not ids:
        raise NotFound(f"nothing is known as {ref!r}")
    if len(ids) > 1:
        raise BadRequest(f"{ref!r} may mean any of " + ", ".join(ids[:NAMED]) + (" and others" if len(ids) > NAMED else ""))
    row = documents.where(F.col("doc_id") == ids[0]).select("doc_id", "source", "type", "url", "title", "created_at", "body").first()
    if not row.url:
        raise Unciteable(f"{row.doc_id} has no address to cite")
    return row


def check_kinds(refs: DataFrame) -> None:
    """An unknown kind of reference rejects the batch before anything is written."""
    bad = refs.where(~F.col("kind").isin(*REF_KINDS)).select("src_doc", "kind").limit(1).collect()
    if bad:
        raise BadRequest(f"{bad[0].src_doc} has a reference of unknown kind {bad[0].kind!r}")


def check_instance(batch: DataFrame, instance: str) -> None:
    """Every document of a batch belongs to the instance that sent it."""
    bad = batch.where((F.col("source") != instance) | ~F.col("doc_id").startswith(f"{instance}:")).select("doc_id").limit(1).collect()
    if bad:
        raise BadRequest(f"{bad[0].doc_id} isn't of instance {instance!r}")


def edge_rule(kind: Column, source_type: Column, target_type: Column, superseding: Column) -> Column:
    """``(kind, confidence)`` of the edge that a resolved reference makes."""

    def pair(rule: tuple[str, float]) -> Column:
        return F.struct(F.lit(rule[0]).alias("kind"), F.lit(rule[1]).alias("confidence"))

    commit_and_pr = ((source_type == "commit") & (target_type == "pr")) | ((source_type == "pr") & (target_type == "commit"))
    out = F.when(kind == "file_path", pair(RULES["file_path"])).when(commit_and_pr, pair(COMMIT_IN_PR))
    out = out.when((source_type == "pr") & (target_type == "issue"), pair(PR_CLOSES_ISSUE)).when(superseding, pair(SUPERSEDES))
    for name, rule in RULES.items():
        out = out.when(kind == name, pair(rule))
    return out


def candidates(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """``src_doc, kind, value, instance, doc_id, type``: admissible targets of references that
    aren't paths: in scope, of a type that the kind admits, and not the document itself."""
    asked = refs.where("kind <> 'file_path'").select("src_doc", "kind", "value", F.coalesce("instance", F.lit("")).alias("instance"))
    return admissible(asked_keys(asked), lookup_keys(documents))


def unique_targets(found: DataFrame) -> DataFrame:
    """Of references with one candidate left, that one; two leave it unresolved."""
    n = F.count("*").over(Window.partitionBy("src_doc", "kind", "value", "instance"))
    return found.withColumn("n", n).where("n = 1").drop("n")


def path_targets(refs: DataFrame, commit_files: DataFrame, documents: DataFrame, most: int = PATH_COMMITS) -> DataFrame:
    """The indexed commits among the newest ``most`` of each clone that touch a referred path.
    ``commit_files``: repo, path, sha, time and, if the order of a log is known, position, as
    :func:`veritrail.sources.history.commit_files` gives them."""
    asked = refs.where("kind = 'file_path'").select("src_doc", "kind", "value", F.coalesce("instance", F.lit("")).alias("instance"))
    commits = documents.where("type = 'commit'").select("doc_id", "source", "type", X.sha_prefix(F.col("doc_id"), F.col("type")).alias("prefix"))
    files = commit_files.join(asked.select(F.col("value").alias("path")).distinct(), "path", "left_semi")
    return _touching(asked, files, commits, most)


def _touching(refs: DataFrame, files: DataFrame, commits: DataFrame, most: int = PATH_COMMITS) -> DataFrame:
    """Of each path reference, the known commits (doc_id, source, type, prefix) among the newest
    ``most`` of a clone that touch it. A path's commits are thinned in partial steps before the
    last one, so a path that a third of all commits touch fills no task."""
    asked = refs.where("kind = 'file_path'").select(*REFERENCE)
    newest = files.withColumn("_salt", F.pmod(F.xxhash64("sha"), F.lit(SALTS)))
    for columns in (["repo", "path", "_salt"], ["repo", "path"]):
        by = [F.asc("position")] if "position" in files.columns else [F.desc("time"), F.asc("sha")]
        order = Window.partitionBy(*columns).orderBy(*by)
        newest = newest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    hits = newest.select("path", F.lower(X.short_sha(F.col("sha"))).alias("prefix")).distinct().join(commits, "prefix")
    found = asked.join(hits, F.col("value") == F.col("path"))
    return found.where(((F.col("instance") == "") | (F.col("source") == F.col("instance"))) & (F.col("doc_id") != F.col("src_doc"))).select(*REFERENCE, "doc_id", "type")


def written(kind: Column, value: Column) -> Column:
    """How a reference is written in a text: a number as ``#n``, anything else as it is."""
    return F.when((kind == "pr_number") & value.contains("#"), F.concat(F.lit("#"), F.substring_index(value, "#", -1))).otherwise(value)


def link(refs: DataFrame, documents: DataFrame, edges: DataFrame, pending: DataFrame, commit_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The next edges and pending references. A reference with one admissible target makes an
    edge and stops pending; any other waits; several commits may touch one path."""
    check_kinds(refs)
    key = ["src_doc", "kind", "value", "instance"]
    refs = refs.select("src_doc", "kind", "value", F.coalesce("instance", F.lit("")).alias("instance")).distinct()
    found = unique_targets(candidates(refs, documents))
    if commit_files is not None:
        found = found.unionByName(path_targets(refs, commit_files, documents))
    made = _edges_of(found, documents.select(F.col("doc_id").alias("src_doc"), F.col("type").alias("source_type"), "title", "body"))
    resolved = found.select(*key).distinct()
    waiting = refs.join(resolved, key, "left_anti")
    return upsert_edges(edges, made), remove_pending(add_pending(pending, waiting), resolved)


def link_pending(documents: DataFrame, edges: DataFrame, pending: DataFrame, commit_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tries everything that waits again."""
    return link(pending, documents, edges, pending, commit_files)


def uncovered(clones: DataFrame, repositories: DataFrame) -> DataFrame:
    """Clones (path, forge, slug) without a source that covers their remote (forge, slug): one
    forge compares names without case, the other exactly."""

    def key(forge: Column, slug: Column) -> Column:
        return F.when(forge == "github", F.lower(slug)).otherwise(slug)

    a = clones.withColumn("_k", key(F.col("forge"), F.col("slug")))
    b = repositories.select("forge", key(F.col("forge"), F.col("slug")).alias("_k"))
    return a.join(b, ["forge", "_k"], "left_anti").select(*clones.columns)


def asked_keys(refs: DataFrame) -> DataFrame:
    """References (src_doc, kind, value, instance) with every ``shape, key`` that they may be found
    under; a path waits under itself. One that has no shape at all is left out."""
    path = F.array(F.struct(F.lit("path").alias("shape"), F.col("value").alias("key")))
    found = F.when(F.col("kind") == "file_path", path).otherwise(shapes(F.col("value")))
    return refs.select("src_doc", "kind", "value", "instance", F.explode(found).alias("k")).select("k.shape", "k.key", "src_doc", "kind", "value", "instance")


def path_keys(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``shape, key`` of the paths that commits (key under shape ``sha``) have touched: what references to those paths wait for."""
    touched = commit_files.select("path", F.lower(X.short_sha(F.col("sha"))).alias("key"))
    return touched.join(commits.where("shape = 'sha'").select("key").distinct(), "key", "left_semi").select(F.lit("path").alias("shape"), F.col("path").alias("key")).distinct()


def admissible(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``src_doc, kind, value, instance, doc_id, type`` of references (with their keys) that aren't
    paths: targets in scope, of a type that the kind admits, and not the document itself."""
    found = asked.where("kind <> 'file_path'").join(keys, ["shape", "key"]).select("src_doc", "kind", "value", "instance", "doc_id", "source", "type").distinct()
    return found.where(_admits() & (F.col("doc_id") != F.col("src_doc"))).drop("source")


def _admits() -> Column:
    """A target's type is one that the reference's kind allows, and its instance is the reference's."""
    typed = F.lit(False)
    for kind, types in TARGET_TYPES.items():
        typed = typed | ((F.col("kind") == kind) & F.col("type").isin(*types))
    free = ~F.col("kind").isin(*TARGET_TYPES)
    return ((F.col("instance") == "") | (F.col("source") == F.col("instance"))) & (typed | free)


def _edges_of(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of references with one target each; ``sources``: src_doc, source_type, title, body. A
    text is joined to what the types alone don't settle."""
    typed = found.join(sources.select("src_doc", "source_type"), "src_doc")
    rule = edge_rule(F.col("kind"), F.col("source_type"), F.col("type"), F.lit(None).cast("boolean"))
    by_type = (F.col("kind") == "file_path") | rule["kind"].isin(COMMIT_IN_PR[0], PR_CLOSES_ISSUE[0])
    open_ = typed.where(~by_type).join(sources.select("src_doc", F.concat_ws("\n", "title", "body").alias("_text")), "src_doc")
    said = X.supersedes(F.col("_text"), written(F.col("kind"), F.col("value")))
    plain = edge_rule(F.col("kind"), F.col("source_type"), F.col("type"), said)
    made = typed.where(by_type).select(F.col("src_doc").alias("src"), F.col("doc_id").alias("dst"), rule.alias("r"))
    return made.unionByName(open_.select(F.col("src_doc").alias("src"), F.col("doc_id").alias("dst"), plain.alias("r"))).select("src", "dst", "r.kind", "r.confidence")


@dataclass
class LinkIndex:
    """Links kept up to date by what arrives.

    ``keys`` stores every way to name a stored document, dealt by the name; ``waiting`` stores
    unresolved references under each name that would resolve them, dealt alike. A batch of
    documents changes names; its references and those that wait for a changed name are all that can
    change their state, so they alone are looked up, and a batch reads the parts of the stored
    tables that its own names fall into, however many documents there are. A reference that has
    one admissible target makes an edge and waits no longer, as in :func:`link`.
    """

    tables: Tables
    commit_files: DataFrame | None = None

    def arrived(self, documents: DataFrame) -> DataFrame:
        """Stores the names of new versions of documents in place of those of the stored ones, and
        returns ``shape, key`` of all that changed. To be called before the documents are stored,
        so that a repeat after a failure finds the same old names."""
        tables = self.tables
        stored = tables.read("documents", tables.touched("documents", documents, "doc_id"))
        old = lookup_keys(stored.join(documents.select("doc_id"), "doc_id", "left_semi"))
        new = settled(lookup_keys(documents))
        unit = ["shape", "key", "doc_id"]
        lost = settled(old.join(new, unit, "left_anti"))
        tables.put("keys", new, lost)
        return settled(new.select("shape", "key").union(lost.select("shape", "key")).distinct())

    def woken(self, changed: DataFrame) -> DataFrame:
        """The waiting references that a changed name may resolve."""
        if self.commit_files is not None:
            changed = changed.union(path_keys(changed, self.commit_files)).distinct()
        changed = settled(changed)
        waits = self.tables.read("waiting", self.tables.touched("waiting", changed, "shape", "key"))
        return waits.join(changed, ["shape", "key"], "left_semi").select(*REFERENCE).distinct()

    def link(self, refs: DataFrame) -> None:
        """Looks references up and stores what follows: edges under both ends, and those that
        wait under their names."""
        check_kinds(refs)
        refs = settled(refs.select("src_doc", "kind", "value", F.coalesce("instance", F.lit("")).alias("instance")).distinct())
        if refs.isEmpty():
            return
        tables, asked = self.tables, settled(asked_keys(refs))
        keys = tables.read("keys", tables.touched("keys", asked, "shape", "key"))
        found = unique_targets(admissible(asked, keys))
        stored = tables.read("documents", tables.touched("documents", refs, "src_doc"))
        if self.commit_files is not None:
            found = found.unionByName(self._of_paths(refs))
        found = settled(found)
        sources = stored.select(F.col("doc_id").alias("src_doc"), F.col("type").alias("source_type"), "title", "body")
        edges = settled(_edges_of(found, sources))
        tables.put("edges", edges)
        tables.put("edges_in", edges)
        done = found.select(*REFERENCE).distinct()
        left = settled(refs.join(done, REFERENCE, "left_anti"))
        tables.put("pending_refs", left, done)
        tables.put("waiting", asked_keys(left), asked.join(done, REFERENCE, "left_semi"))

    def _of_paths(self, refs: DataFrame) -> DataFrame:
        """Targets of path references: only commits of the paths asked for are looked up."""
        tables, paths = self.tables, refs.where("kind = 'file_path'").select("value").distinct()
        files = settled(self.commit_files.join(paths.withColumnRenamed("value", "path"), "path", "left_semi"))
        shas = files.select(F.lit("sha").alias("shape"), F.lower(X.short_sha(F.col("sha"))).alias("key"))
        keys = tables.read("keys", tables.touched("keys", shas, "shape", "key")).where("shape = 'sha' and length(key) = 12")
        commits = keys.select("doc_id", "source", "type", F.col("key").alias("prefix"))
        return _touching(refs, files, commits)

    def relink(self) -> None:
        """Tries everything that waits again, for when clones' histories have changed."""
        self.link(settled(self.tables.read("pending_refs")))
