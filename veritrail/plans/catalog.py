"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunking, display, embedding, flatten
from ..functions import text as X
from ..operators import chains as C
from ..operators import graph as G
from ..operators import link as L
from ..operators import rank as R
from ..operators import search as S
from ..operators import store
from ..operators import vectors as V
from ..schema import TABLES
from ..session import new_folder, settled
from ..sources import forge, history, trackers
from ..sources.changes import after_cursor
from . import testdata as T
from .verbs import FOLLOW_UPS, Engine, blame_groups, history_page, passages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return add


# -- pieces of SQL ----------------------------------------------------------------------

ASKED = [(1, "the license of thing"), (2, "Licensed under CC BY-NC 4.0 the THE"), (3, "version")]
NOW, SINCE, UNTIL = 1735689600, 1704067200, 1706659200
SEEDS = [(1, "c1", 1), (1, "c2", 2), (2, "p1", 1)]

_WORD = r"[\p{L}\p{N}]+"
D = f"d as ({T.DOCS})"


def _phrases(asked=ASKED) -> str:
    import re

    rows = []
    for q, text in asked:
        for compound in re.findall(r"[^\W_]+(?:[._\-/][^\W_]+)*", text.lower()):
            rows.append(f"({q}, '  {'  '.join(re.findall(r'[^\W_]+', compound))}  ')")
    return f"q(query_id, phrase) as (values {', '.join(rows)})"


def bm25_ctes(where: str = "true", phrases: str | None = None) -> str:
    """``phrases``: a CTE q(query_id, phrase) in place of that of ASKED."""
    return rf"""{D},
ch as (select doc_id, n, source, type, created_s, regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '{_WORD}') w from d),
st as (select *, len(w) dl, '  ' || array_to_string(w, '    ') || '  ' s from ch),
cs as (select count(*) n, avg(dl) a from st),
{phrases or _phrases()},
qq as (select query_id, phrase, replace(trim(phrase), '  ', '    ') p, count(*) times from q group by all),
ph as (select distinct p from qq),
tf as (select doc_id, n, source, type, created_s, dl, p, (len(s) - len(replace(s, '  ' || p || '  ', ''))) // (len(p) + 4) f from st, ph where contains(s, '  ' || p || '  ')),
idf as (select p, greatest(ln((cs.n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) idf from tf, cs group by p, cs.n),
sc as (select query_id, doc_id, sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) score from qq join tf using (p) join idf using (p), cs where {where} group by all),
lex as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from sc qualify rank <= 12)"""


def knn_ctes(where: str = "true", asked: str = "select vec_id + 1 query_id, embedding::double[] e from embeddings where vec_id < 3") -> str:
    return f"""v as (select d.doc_id, e.embedding::double[] e from d join embeddings e on e.vec_id = d.n where {where}),
qv as ({asked}),
dist as (select query_id, doc_id, -list_distance(v.e, qv.e) + 0.0 score from v, qv),
vec as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from dist qualify rank <= 12)"""


RRF = """un as (select query_id, doc_id, 0 l, rank from lex union all select query_id, doc_id, 1 l, rank from vec),
fu as (select query_id, doc_id, sum(1.0 / (60 + rank)) score, min(l * 1000 + rank) seen from un group by all),
fused as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 12) desc, seen) position from fu)"""
LIFT = "lifted as (select query_id, doc_id, score relevance, position, url, created_s, body from fused join d using (doc_id) where url <> '')"


def walk_ctes(seeds: str, edges: str, depth: int = 3, direction: str = "both", kinds: str = "true", floor: float = 0.3, admitted: str | None = None) -> str:
    """``walked``: query_id, node, hops, conf, pos, seed, path. ``seeds``: query_id, node, pos."""
    out = "select src frm, dst t, src, dst, kind, conf from ge where src <> dst"
    back = "select dst frm, src t, src, dst, kind, conf from ge where src <> dst"
    steps = {"out": out, "in": back, "both": f"{out} union all {back}"}[direction]
    parts = [
        f"ge as (select src, dst, kind, cast(conf as double) conf from ({edges}) where {kinds})", f"steps as ({steps})",
        f"l0 as (select query_id, node, 0 hops, 1.0::double conf, min(pos) pos, node seed, [node] path from ({seeds}) group by query_id, node)", "v0 as (select * from l0)",
    ]
    admit = f"and s.t in ({admitted})" if admitted else ""
    for k in range(1, depth + 1):
        parts.append(
            f"c{k} as (select query_id, s.t node, l.conf * s.conf conf, l.pos, l.seed, l.path, s.src, s.dst, s.kind from l{k - 1} l join steps s on s.frm = l.node "
            f"where not exists (select 1 from v{k - 1} v where v.query_id = l.query_id and v.node = s.t) and l.conf * s.conf >= {floor} {admit})"
        )
        parts.append(f"f{k} as (select * from c{k} qualify row_number() over (partition by query_id, node order by pos, src, dst, kind) = 1)")
        parts.append(f"p{k} as (select query_id, node, row_number() over (partition by query_id order by pos, src, dst, kind) pos from f{k})")
        parts.append(
            f"l{k} as (select b.query_id, b.node, {k} hops, b.conf, p.pos, b.seed, list_append(b.path, b.node) path from "
            f"(select * from c{k} qualify row_number() over (partition by query_id, node order by conf desc, pos, src, dst, kind) = 1) b join p{k} p using (query_id, node))"
        )
        parts.append(f"v{k} as (select * from v{k - 1} union all select * from l{k})")
    parts.append(f"walked as (select * from v{depth})")
    return ",\n".join(parts)


_SEEDS = "select * from (values " + ", ".join(f"({q}, '{n}', {p})" for q, n, p in SEEDS) + ") x(query_id, node, pos)"


# -- search -----------------------------------------------------------------------------


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, text string")


def asked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return T.view(spark, folder, "select cast(vec_id + 1 as int) query_id, embedding from embeddings where vec_id < 3")


_INDEXES: dict[tuple[str, str], tuple[str, str, S.Index]] = {}


def _files(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files that an index is made of."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for name in ("documents", "embeddings"):
        files = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet{{,/*.parquet}}")) or []
        out += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return "\n".join(out)


def _indexed(spark: SparkSession, folder: str) -> S.Index:
    """The stored index of a folder's documents, whose texts and vectors stay where they are: the first query of
    a session writes it to the shared folder, later ones read their words' postings. One whose files have changed since is written
    anew, and the old one removed."""
    key, files = (spark.sparkContext.applicationId, folder), _files(spark, folder)
    if key not in _INDEXES or _INDEXES[key][0] != files:
        if key in _INDEXES:
            old = spark._jvm.org.apache.hadoop.fs.Path(_INDEXES[key][1])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        place = new_folder(spark, "index")
        _INDEXES[key] = (files, place, S.write_index(T.chunks(spark, folder), place, T.texts(spark, folder)))
    return _INDEXES[key][2]


@query(rf"with {D}, t as (select distinct doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '{_WORD}')) term from d) select term, count(*) df from t group by term")
def lexical_index(spark, folder):
    """Writes the index, if no query of the session has, and reads its words."""
    return _indexed(spark, folder).stored.read("words")


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


_LEX = "select query_id::bigint query_id, doc_id, round(score, 6) score, rank from lex"
_VEC = "select query_id::bigint query_id, doc_id, round(score, 6) + 0.0 score, rank from vec"


@query(f"with {bm25_ctes()} {_LEX}")
def bm25_topk(spark, folder):
    return _scored(S.bm25(_indexed(spark, folder), asked(spark)))


@query(f"with {bm25_ctes("source = 'github' and created_s >= 1704500000")} {_LEX}")
def bm25_filtered(spark, folder):
    where = S.Filters(source="github", since=datetime.fromtimestamp(1704500000, timezone.utc))
    return _scored(S.bm25(_indexed(spark, folder), asked(spark), where=where))


@query(f"with {bm25_ctes()} select doc_id, f::bigint f from tf where p = 'by    nc' and f > 0")
def bm25_phrase(spark, folder):
    return S.frequencies(_indexed(spark, folder), [("by", "nc")]).select("doc_id", "f")


@query(rf"with {D}, t as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '{_WORD}')) term from d) select term, doc_id, count(*) tf from t group by all")
def postings(spark, folder):
    return S.postings(T.chunks(spark, folder)).select("term", "doc_id", "tf")


@query(f"with {D}, {knn_ctes()} {_VEC}")
def knn_topk(spark, folder):
    return _scored(S.knn(_vectors(spark, folder), asked_vectors(spark, folder)))


@query(f"with {D}, {knn_ctes("type = 'pr'")} {_VEC}")
def knn_cells(spark, folder):
    """Through cells around centres, of which only those are read that can hold one of the nearest."""
    cells = V.Cells.write(_vectors(spark, folder), new_folder(spark, "cells"))
    return _scored(cells.nearest(asked_vectors(spark, folder), where=S.Filters(doc_type="pr"))[0])


@query(f"with {D}, {knn_ctes("source = 'jira'")} {_VEC}")
def knn_prefiltered(spark, folder):
    return _scored(S.knn(_vectors(spark, folder), asked_vectors(spark, folder), where=S.Filters(source="jira")))


def _vectors(spark, folder):
    return T.chunks(spark, folder).where("embedding is not null")


def _fused(spark, folder, where: S.Filters | None = None):
    indexed = _indexed(spark, folder)
    both = asked(spark).join(asked_vectors(spark, folder), "query_id")
    return S.hybrid(indexed, both, where=where), indexed.texts


@query(f"with {bm25_ctes()}, {knn_ctes()}, {RRF} select query_id::bigint query_id, doc_id, round(score, 9) score, position from fused")
def rrf_fuse(spark, folder):
    fused, _ = _fused(spark, folder)
    return fused.select(F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.round("score", 9).alias("score"), "position")


@query(f"with {bm25_ctes("type = 'pr'")}, {knn_ctes("type = 'pr'")}, {RRF} select query_id::bigint query_id, doc_id, round(score, 9) score, position from fused")
def hybrid_search(spark, folder):
    fused, _ = _fused(spark, folder, S.Filters(doc_type="pr"))
    return fused.select(F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.round("score", 9).alias("score"), "position")


@query(f"with {bm25_ctes()}, {knn_ctes()}, {RRF}, {LIFT} select query_id::bigint query_id, doc_id, round(relevance, 9) relevance, position, url, md5(body) excerpt from lifted")
def lift_documents(spark, folder):
    fused, chunks = _fused(spark, folder)
    found = S.lift(fused, chunks, T.documents(spark, folder))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.round("relevance", 9).alias("relevance"), "position", "url", F.md5("excerpt").alias("excerpt"))


@query(f"with {bm25_ctes()}, {knn_ctes()}, {RRF}, {LIFT} select query_id::bigint query_id, doc_id, round(relevance / max(relevance) over (partition by query_id), 9) scaled from lifted")
def relevance_scaled(spark, folder):
    fused, chunks = _fused(spark, folder)
    found = R.scaled(S.lift(fused, chunks, T.documents(spark, folder)))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "doc_id", F.round("scaled", 9).alias("scaled"))


# -- ranking ----------------------------------------------------------------------------


@query(f"with {D} select doc_id, round(1 - 0.2 * least(greatest({NOW} - created_s, 0) / (365 * 86400.0), 1), 9) prior from d")
def time_prior_recency(spark, folder):
    now = F.timestamp_seconds(F.lit(NOW))
    return T.documents(spark, folder).select("doc_id", F.round(R.recency_prior(F.col("created_at"), now), 9).alias("prior"))


@query(f"with {D} select doc_id, round(1 / (1 + abs(created_s - {(SINCE + UNTIL) / 2}) / {(UNTIL - SINCE) / 2}), 9) prior from d")
def time_prior_window(spark, folder):
    a, b = (F.timestamp_seconds(F.lit(t)) for t in (SINCE, UNTIL))
    return T.documents(spark, folder).select("doc_id", F.round(R.window_prior(F.col("created_at"), a, b), 9).alias("prior"))


_DEPTH_SEEDS = "select query_id, doc_id node, position pos from lifted"
_PRIOR = f"(1 - 0.2 * least(greatest({NOW} - created_s, 0) / (365 * 86400.0), 1))"
_SCALED = "scaled as (select *, relevance / max(relevance) over (partition by query_id) scaled from lifted)"
_ROLE = "case split_part(node, ':', 2) when 'page' then 'design_doc' when 'issue' then 'linked_ticket' when 'ticket' then 'linked_ticket' else 'linked_change' end"
_ANSWER = f"""{bm25_ctes()}, {knn_ctes()}, {RRF}, {LIFT}, {_SCALED},
{walk_ctes(_DEPTH_SEEDS, T.DOC_EDGES, admitted="select doc_id from d")},
answer as (
  select query_id, doc_id node, 'seed' role, scaled * {_PRIOR} score, 0 hops, created_s from scaled
  union all select w.query_id, w.node, {_ROLE}, pow(0.6, w.hops) * w.conf * s.scaled * {_PRIOR.replace("created_s", "d.created_s")}, w.hops, d.created_s
  from walked w join d on d.doc_id = w.node join scaled s on s.query_id = w.query_id and s.doc_id = w.seed where w.hops > 0 and d.url <> ''
)"""


@query(f"with {_ANSWER} select query_id::bigint query_id, node, role, hops::bigint hops, round(score, 6) score, row_number() over (partition by query_id order by score desc, created_s desc, node) as rank from answer")
def find_decision(spark, folder):
    """All documents of the answers with their scores and ranks."""
    nodes = find_decision_nodes(spark, folder)[0]
    return nodes.select(F.col("query_id").cast("bigint").alias("query_id"), "node", "role", F.col("hops").cast("bigint").alias("hops"), F.round("score", 6).alias("score"), "rank")


def find_decision_nodes(spark, folder):
    documents, edges = T.documents(spark, folder), T.edges(spark, folder, T.DOC_EDGES)
    fused, chunks = _fused(spark, folder)
    hits = settled(R.scaled(S.lift(fused, chunks, documents)))
    seeds = hits.select("query_id", F.col("doc_id").alias("node"), "position")
    paths = G.walk(edges, seeds, admitted=G.admitted(documents))
    now = F.timestamp_seconds(F.lit(NOW))
    first = hits.select("query_id", F.col("doc_id").alias("node"), "position", F.lit("seed").alias("role"), (F.col("scaled") * R.recency_prior(F.col("created_at"), now)).alias("score"), F.lit(0).alias("hops"))
    relevance = hits.select("query_id", F.col("doc_id").alias("seed"), "scaled")
    created = documents.select(F.col("doc_id").alias("node"), F.col("created_at").alias("_c"))
    walked = paths.where("hops > 0").join(relevance, ["query_id", "seed"]).join(created, "node")
    score = R.walked_score(F.col("hops"), F.col("confidence"), F.col("scaled"), R.recency_prior(F.col("_c"), now))
    second = walked.select("query_id", "node", F.col("hops").alias("position"), F.lit(None).cast("string").alias("role"), score.alias("score"), "hops")
    return settled(R.by_rank(R.node_set([first, second], documents))), paths, edges, seeds


@query(
    f"""with recursive {_ANSWER},
steps_of as (select query_id, node tip, unnest(path) node, unnest(range(1, len(path) + 1)) i from walked where hops > 0),
first_lost as (select query_id, tip, min(i) i from steps_of s where not exists (select 1 from answer a where a.query_id = s.query_id and a.node = s.node) group by all),
cut_paths as (select w.query_id, case when f.i is null then path else path[1 : f.i - 1] end chain from walked w left join first_lost f on f.query_id = w.query_id and f.tip = w.node where hops > 0),
links as (
  select a.query_id, src, dst, kind from ge join scaled a on a.doc_id = src join scaled b on b.doc_id = dst and b.query_id = a.query_id where src <> dst
),
every as (select query_id, chain from cut_paths where len(chain) > 1 union all select query_id, [src, dst] from links),
few as (select query_id from every group by query_id having count(*) < 64),
grown as (
  select query_id, chain from every where query_id in (select query_id from few)
  union
  select g.query_id, list_prepend(l.src, g.chain) from grown g join links l on l.query_id = g.query_id and l.dst = g.chain[1] where not list_contains(g.chain, l.src)
),
known as (select distinct query_id, chain, '|' || array_to_string(chain, '|') || '|' s from (select * from every union all select * from grown)),
best as (select k.query_id, k.chain, max(a.score) best from known k join answer a on a.query_id = k.query_id and list_contains(k.chain, a.node)
  where not exists (select 1 from known o where o.query_id = k.query_id and len(o.chain) > len(k.chain) and contains(o.s, k.s)) group by all)
select query_id::bigint query_id, row_number() over (partition by query_id order by best desc, len(chain) desc, chain) as rank, array_to_string(chain, ' -> ') chain from best"""
)
def chains(spark, folder):
    """Chains of the answers. The SQL's joining has no bound of 64; a query below it never gets there."""
    nodes, paths, edges, seeds = find_decision_nodes(spark, folder)
    found = C.chain_table(paths, nodes, G.seed_links(edges, seeds))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", F.array_join("chain", " -> ").alias("chain"))


@query(
    f"""with {D}, nodes as (select type query_id, doc_id node, title, row_number() over (partition by type order by created_s desc, doc_id) rank from d),
linked as (select src node from ({T.DOC_EDGES}) where kind = 'mentions_path')
select query_id, concat(title, ' (', node, ') {C.ALONE}') message, row_number() over (partition by query_id order by rank) as position from nodes where node not in (select node from linked)"""
)
def standalone_gaps(spark, folder):
    order = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "node")
    nodes = T.documents(spark, folder).select(F.col("type").alias("query_id"), F.col("doc_id").alias("node"), "title", "created_at", F.lit("seed").alias("role")).withColumn("rank", F.row_number().over(order))
    linked = T.edges(spark, folder, T.DOC_EDGES).where("kind = 'mentions_path'").select(F.col("src").alias("node")).join(nodes.select("query_id", "node"), "node")
    return C.gaps(nodes, linked.select("query_id", F.array("node").alias("chain"))).select("query_id", "message", "position")


# -- graph ------------------------------------------------------------------------------

_FRONTIER = "('c1'), ('c2'), ('n3'), ('p1')"


def _frontier(spark):
    return spark.createDataFrame([("c1",), ("c2",), ("n3",), ("p1",)], "node string")


for _direction, _test in (("out", "src in (select * from f)"), ("in", "dst in (select * from f)"), ("both", "src in (select * from f) or dst in (select * from f)")):

    @query(f"with f(node) as (values {_FRONTIER}) select src, dst, kind, conf::double confidence from ({T.GRAPH}) where {_test}", f"neighbours_{_direction}")
    def _neighbours(spark, folder, direction=_direction):
        return G.neighbours(T.edges(spark, folder), _frontier(spark), direction)


@query(f"with f(node) as (values {_FRONTIER}) select src, dst, kind, conf::double confidence from ({T.GRAPH}) where (src in (select * from f) or dst in (select * from f)) and kind in ('mentions_path', 'commit_in_pr')")
def neighbours_kinds(spark, folder):
    return G.neighbours(T.edges(spark, folder), _frontier(spark), "both", ["mentions_path", "commit_in_pr"])


_WALKED = "select query_id::bigint query_id, node, hops::bigint hops, round(conf, 9) confidence from walked"


def _walk(spark, folder, **options):
    seeds = spark.createDataFrame(SEEDS, "query_id int, node string, position int")
    rows = G.walk(T.edges(spark, folder), seeds, **options)
    return rows.select(F.col("query_id").cast("bigint").alias("query_id"), "node", F.col("hops").cast("bigint").alias("hops"), F.round("confidence", 9).alias("confidence"))


for _name, _options, _sql in (
    ("walk_depth1", {"depth": 1}, {"depth": 1}),
    ("walk_depth2", {"depth": 2}, {"depth": 2}),
    ("walk_depth3", {"depth": 3}, {"depth": 3}),
    ("walk_floor", {"depth": 3, "floor": 0.65}, {"depth": 3, "floor": 0.65}),
    ("walk_out", {"depth": 3, "direction": "out"}, {"depth": 3, "direction": "out"}),
    ("walk_in", {"depth": 2, "direction": "in"}, {"depth": 2, "direction": "in"}),
    ("walk_kinds", {"depth": 3, "kinds": ["references_doc", "pr_closes_issue"]}, {"depth": 3, "kinds": "kind in ('references_doc', 'pr_closes_issue')"}),
):

    @query(f"with {walk_ctes(_SEEDS, T.GRAPH, **_sql)} {_WALKED}", _name)
    def _walk_query(spark, folder, options=_options):
        return _walk(spark, folder, **options)


_AFTER = 1704067200 + 100 * 21600
_DOC_SEEDS = [3, 40, 100]
_DOC_SEED_SQL = f"select 1 query_id, doc_id node, n pos from d where n in ({', '.join(map(str, _DOC_SEEDS))})"


def _doc_seeds(spark, folder):
    rows = T.documents(spark, folder).where(F.col("n").isin(_DOC_SEEDS))
    return rows.select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"), F.col("n").alias("position"))


@query(f"with {D}, {walk_ctes(_DOC_SEED_SQL, T.DOC_EDGES, admitted=f'select doc_id from d where created_s > {_AFTER}')} {_WALKED}")
def walk_time_after(spark, folder):
    known = G.admitted(T.documents(spark, folder), F.timestamp_seconds(F.lit(_AFTER)))
    rows = G.walk(T.edges(spark, folder, T.DOC_EDGES), _doc_seeds(spark, folder), admitted=known)
    return rows.select(F.col("query_id").cast("bigint").alias("query_id"), "node", F.col("hops").cast("bigint").alias("hops"), F.round("confidence", 9).alias("confidence"))


@query(f"with {D} select src, dst, kind, conf::double confidence from ({T.DOC_EDGES}) where src <> dst and src in (select doc_id from d) and dst in (select doc_id from d)")
def seed_links(spark, folder):
    """With every document as a seed."""
    seeds = T.documents(spark, folder).select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"))
    return G.seed_links(T.edges(spark, folder, T.DOC_EDGES), seeds).select("src", "dst", "kind", "confidence")


@query(
    f"""with {D}, {walk_ctes("select 1 query_id, doc_id node, 1 pos from d where n = 40", T.DOC_EDGES, 2, admitted="select doc_id from d")}
select node, hops::bigint hops, round(pow(0.6, hops) * conf, 9) score, created_s, row_number() over (order by created_s, node) rank from walked join d on d.doc_id = node where url <> ''"""
)
def trace_neighbourhood(spark, folder):
    documents = T.documents(spark, folder)
    seeds = documents.where("n = 40").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"), F.lit(1).alias("position"))
    paths = G.walk(T.edges(spark, folder, T.DOC_EDGES), seeds, 2, admitted=G.admitted(documents))
    stage = paths.select("query_id", "node", F.col("hops").alias("position"), F.lit(None).cast("string").alias("role"), R.walked_score(F.col("hops"), F.col("confidence")).alias("score"), "hops")
    nodes = R.by_time(R.node_set([stage], documents))
    return nodes.select("node", F.col("hops").cast("bigint").alias("hops"), F.round("score", 9).alias("score"), F.unix_seconds("created_at").alias("created_s"), "rank")


@query(
    f"""with {D}, a as (select created_s t from d where n = 40),
{walk_ctes("select 1 query_id, doc_id node, 1 pos from d where n = 40", T.DOC_EDGES, 3, admitted="select doc_id from d where created_s > (select t from a)")}
select node, created_s, row_number() over (order by created_s, node) rank from walked join d on d.doc_id = node where hops > 0 and url <> ''"""
)
def impact_timeline(spark, folder):
    documents = T.documents(spark, folder)
    seeds = documents.where("n = 40").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("node"), F.lit(1).alias("position"))
    after = F.timestamp_seconds(F.lit(1704067200 + 40 * 21600))
    paths = G.walk(T.edges(spark, folder, T.DOC_EDGES), seeds, admitted=G.admitted(documents, after)).where("hops > 0")
    stage = paths.select("query_id", "node", F.col("hops").alias("position"), F.lit("follow_up").alias("role"), F.lit(1.0).alias("score"), "hops")
    return R.by_time(R.node_set([stage], documents)).select("node", F.unix_seconds("created_at").alias("created_s"), "rank")


# -- store ------------------------------------------------------------------------------


@query("select src, dst, kind, max(conf)::double confidence from (select concat('o', l_orderkey) src, concat('s', l_suppkey) dst, 'mentions_path' kind, l_discount conf from lineitem union all select concat('o', l_orderkey), concat('s', l_suppkey), 'mentions_path', l_tax from lineitem) group by all")
def edge_upsert_max(spark, folder):
    old = T.edges(spark, folder, "select concat('o', l_orderkey) src, concat('s', l_suppkey) dst, 'mentions_path' kind, l_discount conf from lineitem")
    new = T.edges(spark, folder, "select concat('o', l_orderkey) src, concat('s', l_suppkey) dst, 'mentions_path' kind, l_tax conf from lineitem")
    return store.upsert_edges(old, new)


@query(f"with {D} select doc_id, case when n % 10 = 3 then concat('new ', n) else title end title from d where n % 7 <> 0 or n % 10 = 3")
def upsert_documents(spark, folder):
    rows = T.documents(spark, folder)
    batch = rows.where("n % 10 = 3").withColumn("title", F.concat(F.lit("new "), "n"))
    older = batch.withColumn("title", F.lit("old")).withColumn("at", F.lit(1))
    both = older.unionByName(batch.withColumn("at", F.lit(2)))
    return store.upsert_documents(rows.where("n % 7 <> 0"), both, "at").select("doc_id", "title")


@query(f"with {D} select doc_id, 0::bigint ordinal, case when n % 4 = 0 then 'changed' else md5(body) end text from d where n % 8 <> 4")
def replace_chunks(spark, folder):
    rows = T.chunks(spark, folder).withColumn("text", F.md5("text"))
    touched = rows.where("n % 4 = 0")
    new = rows.where("n % 8 = 0").withColumn("text", F.lit("changed"))
    out = store.replace_chunks(rows, touched, new, T.documents(spark, folder), 64)
    return out.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "text")


@query(f"select (select count(*) from documents) documents, (select count(*) from documents) chunks, (select count(*) from ({T.DOC_EDGES})) edges")
def stats_counts(spark, folder):
    return store.counts(T.documents(spark, folder), T.chunks(spark, folder), T.edges(spark, folder, T.DOC_EDGES))


@query("select source, count(*) documents from documents group by source")
def docs_per_source(spark, folder):
    return store.per_source(T.view(spark, folder, "select source from documents"))


@query("with c(source, mark) as (values ('src1', 100), ('gone', 200)), n(source) as (values ('src1'), ('new')), k as (select source, count(*) documents from documents group by source) select source, coalesce(documents, 0) documents, mark::bigint checkpoint_s, source in (select source from n) configured from k full join c using (source) full join n using (source)")
def source_status(spark, folder):
    cursors = spark.sql("select * from values ('src1', timestamp_seconds(100)), ('gone', timestamp_seconds(200)) as (connector, updated_at)")
    declared = spark.createDataFrame([("src1",), ("new",)], "source string")
    out = store.source_status(T.view(spark, folder, "select source from documents"), cursors, declared)
    return out.select("source", "documents", F.unix_seconds("checkpoint_at").alias("checkpoint_s"), "configured")


@query(f"with {D} select doc_id, title from d where n in (1, 5, 8, 99999999)")
def documents_by_id(spark, folder):
    rows = T.documents(spark, folder)
    wanted = rows.where("n in (1, 5, 8)").select("doc_id").union(spark.createDataFrame([("none",)], "doc_id string"))
    return store.by_id(rows, wanted).select("doc_id", "title")


@query(
    "with e as (select cast(event_id as varchar) doc_id, floor(epoch(ts))::bigint s, event_type kind from events), m as (select s, doc_id from e order by s, doc_id limit 1 offset 500) "
    "select e.doc_id, e.s from e, m where (e.s, e.doc_id) > (m.s, m.doc_id) or (kind = 'click' and e.s >= m.s)"
)
def cursor_resume(spark, folder):
    rows = T.view(spark, folder, "select cast(event_id as string) doc_id, event_type type, cast(ts as timestamp) ts from events")
    rows = rows.select("doc_id", "type", F.date_trunc("SECOND", "ts").alias("updated_at"))
    mark = rows.orderBy("updated_at", "doc_id").limit(501).orderBy(F.desc("updated_at"), F.desc("doc_id")).first()
    out = after_cursor(rows, mark.updated_at, mark.doc_id, tie_type="click")
    return out.select("doc_id", F.unix_seconds("updated_at").alias("s"))


@query("select user_id round, event_id seq, cast(sum(event_id % 3) over w as bigint) documents, cast(sum(event_id % 5) over w as bigint) chunks from events window w as (partition by user_id order by event_id)")
def sync_totals(spark, folder):
    rows = T.view(spark, folder, "select user_id round, event_id seq, event_id % 3 documents, event_id % 5 chunks from events")
    return store.running_totals(rows)



# -- references and text ----------------------------------------------------------------


def _lists(name: str, pattern: str, column, prepare: str = "t", after: str = "x"):
    @query(rf"with r as ({T.REFS}) select n, array_to_string([{after} for x in regexp_extract_all({prepare}, '{pattern}')], '|') found from r", name)
    def run(spark, folder):
        return T.view(spark, folder, T.REFS).select("n", F.array_join(column(F.col("t")), "|").alias("found"))


_URL = r"https?://[^\s<>()\[\]{}\"`]+"
_lists("extract_ticket_keys", r"[A-Z][A-Z0-9]+-\d+", X.ticket_keys)
_lists("extract_urls", _URL, X.urls, after="rtrim(x, '.,;:!?')")
_lists("extract_shas", r"\b[0-9a-f]{7,40}\b", X.commit_shas)
_lists("extract_paths", r"[\w.-]+(?:/[\w.-]+)+\.[A-Za-z][A-Za-z0-9]*", X.file_paths, prepare=f"regexp_replace(t, '{_URL}', ' ', 'g')")


@query(rf"with r as ({T.REFS}) select n, concat('acme/app#', substr(regexp_extract(t, 'acme/app#(\d+)'), 10), '|me/own', regexp_extract(t, ' (#\d+)', 1)) found from r")
def extract_numbers(spark, folder):
    return T.view(spark, folder, T.REFS).select("n", F.array_join(X.numbers(F.col("t"), F.lit("me/own")), "|").alias("found"))


@query(rf"with r as ({T.REFS}) select n, (regexp_extract_all(t, '[A-Z][A-Z0-9]+-\d+'))[1] ticket, 1::bigint tickets from r")
def ref_set_dedupe(spark, folder):
    rows = T.view(spark, folder, T.REFS)
    found = X.ref_set(F.concat(X.refs(F.col("t"), F.lit("me/own")), F.array(X.scoped_ref("ticket_key", F.concat(F.lit("PROJ-"), F.col("n") % 50), F.lit("jira")))))
    of = lambda keys: F.struct(F.get(keys, F.lit(0))["value"].alias("ticket"), F.size(keys).cast("bigint").alias("tickets"))
    return rows.select("n", X.let(F.filter(found, lambda r: r["kind"] == "ticket_key"), of).alias("x")).select("n", "x.ticket", "x.tickets")


def _resolve(name: str, refs: str, sql: str):
    @query(f"with {D} {sql}", name)
    def run(spark, folder):
        asked_ = T.view(spark, folder, f"select {refs} ref from documents")
        return L.resolve(asked_, T.documents(spark, folder)).select("ref", "doc_id")


_resolve("resolve_url", "concat('https://ex.test/d/', doc_id)", "select url ref, doc_id from d where url <> ''")
_resolve("resolve_key", "concat('PROJ-', doc_id)", "select concat('PROJ-', n) ref, doc_id from d where type = 'ticket'")
_resolve("resolve_sha_prefix", "substr(md5(cast(doc_id as string)), 1, 9)", "select substr(x, 1, 9) ref, doc_id from (select doc_id, md5(cast(n as string)) x from d where type = 'commit') union select r.ref, d.doc_id from (select substr(md5(cast(n as string)), 1, 9) ref, n from d) r join d on d.type = 'commit' and substr(md5(cast(d.n as string)), 1, 9) = r.ref")
_resolve("resolve_number", "concat('acme/app#', doc_id)", "select concat('acme/app#', n) ref, doc_id from d where type in ('pr', 'issue')")
_resolve("resolve_bare_number", "concat('#', doc_id)", "select concat('#', n) ref, doc_id from d where type in ('pr', 'issue')")
_resolve("resolve_doc_id", T.doc_key("doc_id"), "select doc_id ref, doc_id from d")

_LINK_REFS = f"""select {T.doc_key("doc_id")} src_doc, 'ticket_key' kind, concat('PROJ-', doc_id + 1) value, '' instance from documents
 union all select {T.doc_key("doc_id")} src_doc, 'url' kind, concat('https://ex.test/d/', doc_id + 3) value, case doc_id % 4 when 0 then 'github' else '' end instance from documents
 union all select {T.doc_key("doc_id")} src_doc, 'pr_number' kind, concat('acme/app#', doc_id - 1) value, '' instance from documents"""
_LINKED = f"""{D}, r as ({_LINK_REFS}), s as (select n, doc_id src, type from d),
hit as (
  select src_doc, r.kind, value, instance, t.doc_id dst, s.type st, t.type tt from r join s on s.src = src_doc join d t on
   (r.kind = 'ticket_key' and t.type = 'ticket' and value = concat('PROJ-', t.n)) or (r.kind = 'url' and t.url = value) or (r.kind = 'pr_number' and t.type in ('pr', 'issue') and value = concat('acme/app#', t.n))
  where (instance = '' or t.source = instance) and t.doc_id <> src_doc
)"""


def _linked(spark, folder):
    refs = T.view(spark, folder, _LINK_REFS)
    edges = spark.createDataFrame([], "src string, dst string, kind string, confidence double")
    pending = spark.createDataFrame([], "src_doc string, kind string, value string, instance string")
    return L.link(refs, T.documents(spark, folder), edges, pending)


@query(
    f"""with {_LINKED}, e as (select src_doc src, dst, case when (st, tt) in (('commit', 'pr'), ('pr', 'commit')) then 'commit_in_pr' when st = 'pr' and tt = 'issue' then 'pr_closes_issue' else 'references_doc' end k,
case when (st, tt) in (('commit', 'pr'), ('pr', 'commit'), ('pr', 'issue')) or kind = 'url' then 1.0 else 0.9 end c from hit) select src, dst, k kind, max(c)::double confidence from e group by all"""
)
def link_edges(spark, folder):
    return _linked(spark, folder)[0]



@query(f"with {_LINKED} select src_doc, kind, value, instance from r where (src_doc, kind, value, instance) not in (select src_doc, kind, value, instance from hit)")
def pending_refs(spark, folder):
    return _linked(spark, folder)[1]


@query("select o_orderkey n, o_orderkey % 3 = 0 as hit from orders")
def supersede_phrase(spark, folder):
    rows = T.view(spark, folder, "select o_orderkey n, concat('intro\\n', case o_orderkey % 3 when 0 then 'This Replaces PROJ-7, at last' when 1 then 'replaces PROJ-71' else 'PROJ-7\\nsupersedes it' end) t from orders")
    return rows.select("n", X.supersedes(F.col("t"), F.lit("PROJ-7")).alias("hit"))


@query(
    f"""with {bm25_ctes()}, {knn_ctes()}, {RRF}, {LIFT}, top as (select * from lifted qualify row_number() over (partition by query_id order by position) <= 5)
select query_id::bigint query_id, max(created_s) - min(created_s) <= 2 * 30 * 86400 bounded, arg_min(doc_id, created_s * 1000 + position) anchor, min(created_s) - 30 * 86400 since_s, min(created_s) + 30 * 86400 until_s from top group by query_id"""
)
def event_window(spark, folder):
    fused, chunks = _fused(spark, folder)
    found = S.lift(fused, chunks, T.documents(spark, folder))
    order = Window.partitionBy("query_id").orderBy("position")
    best = found.withColumn("k", F.row_number().over(order)).where("k <= 5")
    first, last, month = F.unix_seconds(F.min("created_at")), F.unix_seconds(F.max("created_at")), 30 * 86400
    return best.groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(
        (last - first <= 2 * month).alias("bounded"), F.min_by("doc_id", F.struct("created_at", "position")).alias("anchor"), (first - month).alias("since_s"), (first + month).alias("until_s")
    )


@query(f"with {D} select doc_id, array_to_string(string_split(doc_id, ':')[3:], ':') external, case when type = 'commit' then substr(md5(cast(n as string)), 1, 12) else '' end prefix, case when contains(doc_id, '#') then string_split(doc_id, '#')[1] else doc_id end thread from d")
def document_keys(spark, folder):
    c = F.col("doc_id")
    return T.documents(spark, folder).select("doc_id", X.external_id(c).alias("external"), X.sha_prefix(c, F.col("type")).alias("prefix"), X.thread_id(c).alias("thread"))


@query("select doc_id, md5(case when length(text) <= 800 then text else concat(substr(text, 1, 800), chr(10), chr(10), '[truncated: 800 of ', format('{:,}', length(text)), ' characters shown.]') end) excerpt from documents")
def excerpt_cap(spark, folder):
    return T.view(spark, folder, "select doc_id, text from documents").select("doc_id", F.md5(X.capped(F.col("text"), 800)).alias("excerpt"))


@query("select doc_id, md5(substr(text, 1, (select max(i) from unnest(range(0, 501)) u(i) where strlen(substr(text, 1, i)) <= 500))) excerpt from documents")
def excerpt_bytes(spark, folder):
    return T.view(spark, folder, "select doc_id, text from documents").select("doc_id", F.md5(X.byte_excerpt(F.col("text"), 500)).alias("excerpt"))



@query(
    """select n, regexp_extract(u, '^https?://([^/:?#]+)', 1) host, case when n % 4 < 3 then concat(substr(k, 1, 8), '-', substr(k, 9, 4), '-', substr(k, 13, 4), '-', substr(k, 17, 4), '-', substr(k, 21)) end page_key,
case when n % 4 = 1 then null else k end page_id from (select page_id n, md5(cast(page_id as varchar)) k, concat(case page_id % 4 when 0 then 'https://www.notion.so/Plan-' when 1 then 'https://team.notion.site/' when 2 then 'http://notion.so/a/b-' else 'https://x.test/' end, md5(cast(page_id as varchar))) u from pages)"""
)
def url_parts(spark, folder):
    rows = T.view(spark, folder, "select page_id n, md5(cast(page_id as string)) k, concat(case page_id % 4 when 0 then 'https://www.notion.so/Plan-' when 1 then 'https://team.notion.site/' when 2 then 'http://notion.so/a/b-' else 'https://x.test/' end, md5(cast(page_id as string)), case page_id % 4 when 2 then '?v=1#x' else '' end) u from pages")
    given = F.when(F.col("n") % 4 == 1, F.concat("k", F.lit("0"))).otherwise(F.concat(F.lit(" "), F.upper(X.dashed(F.col("k")))))
    return rows.select("n", F.regexp_extract("u", "^https?://([^/:?#]+)", 1).alias("host"), X.page_key(F.col("u")).alias("page_key"), X.page_id(given).alias("page_id"))


@query(
    """with c as (select conv_id, turn, text, turn - lag(turn) over (partition by conv_id order by turn) gap from conversations where turn % 3 <> 1),
p as (select conv_id, turn, case when turn - lag(turn) over (partition by conv_id order by turn) > 1 then concat('…', chr(10), chr(10), text) else text end part from c)
select conv_id, md5(string_agg(part, chr(10) || chr(10) order by turn)) text from p group by conv_id"""
)
def passages_join(spark, folder):
    rows = T.view(spark, folder, "select conv_id doc_id, turn ordinal, text from conversations where turn % 3 <> 1").withColumn("query_id", F.lit(1))
    return passages(rows, rows).select(F.col("doc_id").alias("conv_id"), F.md5("text").alias("text"))


@query("select row_number() over (order by min(event_id)) as position, user_id, count(*) lines from events group by user_id")
def blame_group(spark, folder):
    rows = T.view(spark, folder, "select cast(user_id as string) sha, event_id line_start, array(props) lines, event_type subject from events")
    return blame_groups(rows).select(F.col("position").cast("bigint").alias("position"), F.col("sha").cast("bigint").alias("user_id"), F.size("lines").cast("bigint").alias("lines"))


@query("with l as (select row_number() over (order by ts desc, event_id desc) as position, md5(cast(event_id as varchar)) sha from events), b as (select position p from l where sha = md5('77')) select position, sha from l, b where position > p order by position limit 20")
def history_window(spark, folder):
    events = T.view(spark, folder, "select event_id, ts, md5(cast(event_id as string)) sha from events")
    rows = R.numbered(events, [F.desc("ts"), F.desc("event_id")], name="position")
    before = spark.range(1).select(F.md5(F.lit("77")).alias("s")).first().s
    return history_page(rows, before=before).select(F.col("position").cast("bigint").alias("position"), "sha")


# -- not SQL: rows only, held against goldens and brute force in the tests --------------


@query()
def chunk_split(spark, folder):
    found = chunking.chunk(T.documents(spark, folder))
    return found.select("doc_id", "ordinal", F.octet_length("text").alias("bytes"), "thread_id", F.md5("text").alias("digest"))


@query()
def embed_hash(spark, folder):
    rows = T.view(spark, folder, "select doc_id, text from documents")
    return rows.select("doc_id", F.transform(embedding.embed(F.col("text")), lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query()
def adf_flatten(spark, folder):
    rows = T.view(spark, folder, "select conv_id, turn, role, text from conversations")
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("heading").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))).alias("content")), F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))).alias("content")))
    return rows.select("conv_id", "turn", flatten.flatten_issue(tree).alias("text"))


SQL["adf_flatten"] = "select conv_id, turn, trim(concat('# ', role, chr(10), text)) text from conversations"


@query()
def notion_flatten(spark, folder):
    rows = T.view(spark, folder, "select conv_id, turn, role, text from conversations")
    rich = F.array(F.struct(F.col("text").alias("plain_text")))
    tree = F.to_json(F.array(F.struct(F.lit("heading_1").alias("type"), F.struct(F.array(F.struct(F.col("role").alias("plain_text"))).alias("rich_text")).alias("heading_1"), F.lit(None).cast("struct<rich_text:array<struct<plain_text:string>>>").alias("quote")), F.struct(F.lit("quote").alias("type"), F.lit(None).cast("struct<rich_text:array<struct<plain_text:string>>>").alias("heading_1"), F.struct(rich.alias("rich_text")).alias("quote"))))
    return rows.select("conv_id", "turn", flatten.flatten_page(tree).alias("text"))


SQL["notion_flatten"] = "select conv_id, turn, concat('# ', role, chr(10), '> ', trim(text)) text from conversations"


# -- text functions over derived strings ------------------------------------------------


@query("select o_orderkey n, concat('acme/sub/app#', o_custkey, '|me/own#', o_orderkey % 20) found from orders")
def extract_merge_numbers(spark, folder):
    rows = T.view(spark, folder, "select o_orderkey n, concat('closes acme/sub/app!', o_custkey, ' and !', o_orderkey % 20) t from orders")
    return rows.select("n", F.array_join(X.merge_numbers(F.col("t"), F.lit("me/own")), "|").alias("found"))


@query("select o_orderkey n, concat('PROJ-', o_orderkey % 50 + 1) found from orders")
def refs_without_own_key(spark, folder):
    rows = T.view(spark, folder, "select o_orderkey n, concat('PROJ-', o_orderkey % 50) own, concat('PROJ-', o_orderkey % 50, ' like PROJ-', o_orderkey % 50 + 1) t from orders")
    found = X.without_self(X.ref_set(X.refs(F.col("t"), F.lit("me/own"))), F.col("own"))
    return rows.select("n", F.array_join(F.transform(found, lambda r: r["value"]), "|").alias("found"))


@query("select event_id n, floor(epoch(ts))::bigint - 7200 s from events")
def ticket_times(spark, folder):
    rows = T.view(spark, folder, "select event_id n, date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'.000+0200'\") t from events")
    return rows.select("n", F.unix_seconds(X.ticket_time(F.col("t"))).alias("s"))


@query("select event_id n, d::bigint day_s, case when event_id % 3 = 0 then null else d end::bigint lower_s, case when event_id % 3 = 0 then null else d + 86399 end::bigint upper_s from (select event_id, epoch(date_trunc('day', ts)) d from events)")
def event_dates(spark, folder):
    rows = T.view(spark, folder, "select event_id n, date_format(cast(ts as timestamp), 'yyyy-MM-dd') t from events")
    bound = F.when(F.col("n") % 3 == 0, F.concat(F.lit("after "), "t")).otherwise(F.concat(F.lit(" "), "t"))
    at = lambda c: F.unix_seconds(c)
    return rows.select("n", at(X.event_date(F.concat("t", F.lit("T00:00:00Z")))).alias("day_s"), at(X.window_bound(bound, False)).alias("lower_s"), at(X.window_bound(bound, True)).alias("upper_s"))


@query("select event_id n, floor(epoch(ts))::bigint created_s, floor(epoch(ts))::bigint + case when event_id % 2 = 0 then 60 else 0 end updated_s from events")
def both_times(spark, folder):
    rows = T.view(spark, folder, "select event_id n, cast(ts as timestamp) c, case when event_id % 2 = 0 then cast(ts as timestamp) + interval 60 seconds end u from events")
    made = rows.select("n", *X.both_times(F.col("c"), F.col("u")))
    return made.select("n", F.unix_seconds("created_at").alias("created_s"), F.unix_seconds("updated_at").alias("updated_s"))


@query(f"with {D} select n, doc_id, substr(md5(cast(n as varchar)), 1, 12) short from d")
def document_ids(spark, folder):
    rows = T.documents(spark, folder)
    made = X.doc_id(F.col("source"), F.col("type"), X.external_id(F.col("doc_id")))
    return rows.select("n", made.alias("doc_id"), X.short_sha(F.md5(F.col("n").cast("string"))).alias("short"))


@query(f"with a as (select event_id n, floor({NOW} - epoch(ts))::bigint a from events) select n, a age_seconds, case when a < 5 then 'just now' when a < 60 then concat(a, 's ago') when a < 3600 then concat(a // 60, 'm ago') when a < 172800 then concat(a // 3600, 'h ago') else concat(a // 86400, 'd ago') end age, case when n % 3 = 1 then '1 batch' else concat(n % 3, ' batches') end counted from a")
def age_texts(spark, folder):
    rows = T.view(spark, folder, "select event_id n, date_trunc('SECOND', cast(ts as timestamp) + interval 999999 microseconds) checkpoint_at from events")
    aged = store.ages(rows, datetime.fromtimestamp(NOW, timezone.utc))
    return aged.select("n", "age_seconds", display.age(F.col("age_seconds")).alias("age"), display.counted(F.col("n") % 3, "batch", "batches").alias("counted"))


@query("select event_id n, event_id % 5 between 1 and 3 good, concat('a\\x1b[', event_id, 'm\\nb') line from events")
def citations_and_inert_lines(spark, folder):
    rows = T.view(spark, folder, "select event_id n, case event_id % 5 when 0 then 'none' when 4 then 'so [4], or [1]' else concat('so [ ', event_id % 5, ' ]') end t from events")
    return rows.select("n", X.cites(F.col("t"), F.lit(3)).alias("good"), display.inert_line(F.concat(F.lit("a\x1b["), "n", F.lit("m\nb"))).alias("line"))


# -- lookups ----------------------------------------------------------------------------


@query(f"with {D} select page_id position, md5(cast(page_id as varchar)) sha, doc_id from pages left join d on d.n = page_id and d.type = 'commit'")
def commit_lookup(spark, folder):
    shas = T.view(spark, folder, "select page_id position, upper(md5(cast(page_id as string))) sha from pages")
    found = _engine(spark, folder).commits_for(shas)
    return found.select("position", F.lower("sha").alias("sha"), "doc_id")


@query(
    f"""with {D}, r as (select distinct doc_id src, concat('src/m', n // 5 % 40, '.py') path from d where type <> 'commit'),
f as (select concat('r', n % 2) repo, concat('src/m', n // 5 % 40, '.py') path, n, row_number() over (partition by n % 2, n // 5 % 40 order by created_s desc, md5(cast(n as varchar))) k from d)
select src, d.doc_id dst from r join f using (path) join d on d.n = f.n where k <= 50 and d.type = 'commit' and src <> d.doc_id"""
)
def path_commits(spark, folder):
    """Every document is a commit of one of two clones; every fifth is an indexed one."""
    rows = T.documents(spark, folder)
    path = F.concat(F.lit("src/m"), F.floor(F.col("n") / 5) % 40, F.lit(".py"))
    refs = rows.where("type <> 'commit'").select(F.col("doc_id").alias("src_doc"), F.lit("file_path").alias("kind"), path.alias("value"), F.lit("").alias("instance"))
    files = rows.select(F.concat(F.lit("r"), F.col("n") % 2).alias("repo"), path.alias("path"), F.md5(F.col("n").cast("string")).alias("sha"), F.col("created_at").alias("time"))
    return L.path_targets(refs, files, rows).select(F.col("src_doc").alias("src"), F.col("doc_id").alias("dst"))


_CHANGES = """select concat('r', o_orderkey % 2) repo, row_number() over (partition by o_orderkey % 2 order by o_orderdate desc, o_orderkey) as position, md5(cast(o_orderkey as {0})) sha,
 o_orderkey n from orders"""


@query(
    f"""with recursive c as ({_CHANGES.format("varchar")}),
e as (
  select distinct repo, position, sha, concat('src/p', l_partkey % 40, '.py') path, case when l_linenumber = 5 and l_partkey % 40 <> l_suppkey % 40 then concat('src/p', l_suppkey % 40, '.py') end old,
    l_linenumber = 6 and l_partkey % 3 = 0 dropped from c join lineitem on l_orderkey = n
),
r as (select repo, path, position as pos, min(old) old from e where old is not null group by all),
l as (select repo, path, position, not dropped there from e union all select repo, old, position, false from e where old is not null),
h as (select repo, path from (select repo, path, min({{'p': position, 'lost': not there}}) m from l group by all) where not m.lost),
x as (select repo, path name, 0::bigint since from h union select repo, old, pos from r),
nxt as (select x.repo, x.name, x.since, min({{'pos': r.pos, 'old': r.old}}) filter (r.pos is not null) m from x left join r on r.repo = x.repo and r.path = x.name and r.pos > x.since group by all),
walk as (
  select h.repo, h.path, h.path as name, 0::bigint as since from h
  union all select w.repo, w.path, n.m.old, n.m.pos from walk w join nxt n on n.repo = w.repo and n.name = w.name and n.since = w.since where n.m.pos is not null
)
select distinct w.repo, w.path, e.position, e.sha from walk w join nxt n on n.repo = w.repo and n.name = w.name and n.since = w.since
join (select repo, path, position, sha from e union select repo, old, position, sha from e where old is not null) e on e.repo = w.repo and e.path = w.name and e.position > w.since and (n.m.pos is null or e.position <= n.m.pos)"""
)
def clone_history(spark, folder):
    """Orders as the commits of two clones, their lines as changes of files, some of them renames
    and deletions: the commits of each path that is there now, under all its names."""
    orders = T.view(spark, folder, "select concat('r', o_orderkey % 2) repo, md5(cast(o_orderkey as string)) sha, o_orderkey n, o_orderdate from orders")
    commits = R.numbered(orders, [F.desc("o_orderdate"), F.asc("n")], ("repo",), "position")
    lines = T.view(spark, folder, "select l_orderkey n, l_linenumber, l_partkey, l_suppkey from lineitem")
    path = lambda c: F.concat(F.lit("src/p"), F.col(c) % 40, F.lit(".py"))
    renamed = (F.col("l_linenumber") == 5) & (F.col("l_partkey") % 40 != F.col("l_suppkey") % 40)
    dropped = (F.col("l_linenumber") == 6) & (F.col("l_partkey") % 3 == 0)
    changes = commits.join(lines, "n").select(
        "repo", F.col("position").cast("bigint").alias("position"), "sha", F.lit(None).cast("timestamp").alias("time"), F.when(renamed, F.lit("R")).when(dropped, F.lit("D")).otherwise(F.lit("M")).alias("status"),
        path("l_partkey").alias("path"), F.when(renamed, path("l_suppkey")).alias("old_path"),
    )
    return history.commit_files(changes).select("repo", "path", "position", "sha")


@query("select c_custkey n from customer where not (c_nationkey % 2 = 0 and c_custkey % 3 = 0) and not (c_nationkey % 2 = 1 and c_custkey % 6 = 0)")
def uncovered_clones(spark, folder):
    clones = T.view(spark, folder, "select c_custkey path, case c_nationkey % 2 when 0 then 'github' else 'gitlab' end forge, concat('Acme/App', c_custkey) slug from customer")
    known = T.view(spark, folder, "select 'github' forge, concat('acme/app', c_custkey) slug from customer where c_custkey % 3 = 0 union all select 'gitlab', concat('Acme/App', c_custkey) from customer where c_custkey % 6 = 0 union all select 'gitlab', concat('acme/app', c_custkey) from customer")
    return L.uncovered(clones, known).select(F.col("path").alias("n"))


@query(f"with {walk_ctes(_SEEDS, T.GRAPH)} select query_id::bigint query_id, node, seed, array_to_string(path, ' -> ') path from walked")
def walk_paths(spark, folder):
    seeds = spark.createDataFrame(SEEDS, "query_id int, node string, position int")
    rows = G.walk(T.edges(spark, folder), seeds)
    return rows.select(F.col("query_id").cast("bigint").alias("query_id"), "node", "seed", F.array_join("nodes", " -> ").alias("path"))


@query(f"with {D} select distinct type query_id, 1::bigint as position, '{C.UNLINKED}' message from d")
def collapsed_gaps(spark, folder):
    nodes = T.documents(spark, folder).select(F.col("type").alias("query_id"), F.col("doc_id").alias("node"), "title", F.lit("seed").alias("role"), F.col("n").alias("rank"))
    none = spark.createDataFrame([], "query_id string, chain array<string>")
    any_edge = not T.edges(spark, folder, T.DOC_EDGES).where("kind = 'supersedes'").isEmpty()
    return C.gaps(nodes, none, any_edge).select("query_id", "position", "message")


# -- verbs through the engine -----------------------------------------------------------


def _engine(spark: SparkSession, folder: str) -> Engine:
    """Over the test tables; a question's vector is the first of embeddings, whatever it asks."""
    vector = [float(x) for x in T.view(spark, folder, "select embedding from embeddings where vec_id = 0").first().embedding]
    chunks, edges = T.chunks(spark, folder), T.edges(spark, folder, T.DOC_EDGES)
    return Engine(spark, T.documents(spark, folder), chunks, edges, model=lambda texts: [vector for _ in texts], width=len(vector), opened=lambda: _indexed(spark, folder))


def _nodes(answer):
    return answer.nodes.select("node", "role", F.col("hops").cast("bigint").alias("hops"), F.round("score", 6).alias("score"), "rank")


_ONE_VECTOR = "select 1 query_id, embedding::double[] e from embeddings where vec_id = 0"
_BY_TIME = "select node, role, hops::bigint hops, round(score, 6) score, row_number() over (order by created_s, node) as rank from found"
_SEED_40 = "select 1 query_id, doc_id node, 1 pos from d where n = 40"


def _found(seed_role: str, walked_role: str, matches: str = "") -> str:
    return f"""found as (
  select node, case when hops = 0 then '{seed_role}' else {walked_role} end role, hops, pow(0.6, hops) * conf score, created_s from walked join d on d.doc_id = node where url <> '' {matches}
)"""


#: Matches are scaled by the best of all of them, those that the walk has found too.
_MATCHES = "union all select doc_id, 'semantic_match', null, relevance / most, created_s from (select *, max(relevance) over () most from lifted where {0}) where doc_id not in (select node from walked)"


@query(f"with {D}, {walk_ctes(_SEED_40, T.DOC_EDGES, 2, admitted='select doc_id from d')}, {_found('seed', _ROLE)} {_BY_TIME}")
def trace(spark, folder):
    return _nodes(_engine(spark, folder).trace("https://ex.test/d/40"))


_AFTER_40 = 1704067200 + 40 * 21600
_IMPACT_TEXT = f"""t as (select concat('{FOLLOW_UPS}', title, chr(10), chr(10), substr(body, 1, (select max(i) from unnest(range(0, 501)) u(i) where strlen(substr(body, 1, i)) <= 500))) t from d where n = 40),
q as (select 1 query_id, unnest([concat('  ', array_to_string(regexp_extract_all(c, '{_WORD}'), '  '), '  ') for c in regexp_extract_all(strip_accents(lower(t)), '{_WORD}(?:[._/-]{_WORD})*')]) phrase from t)"""


@query(
    f"""with {bm25_ctes(f"created_s >= {_AFTER_40}", _IMPACT_TEXT)}, {knn_ctes(f"d.created_s >= {_AFTER_40}", _ONE_VECTOR)}, {RRF}, {LIFT},
{walk_ctes(_SEED_40, T.DOC_EDGES, 3, admitted=f"select doc_id from d where created_s > {_AFTER_40}")}, {_found("seed", "'follow_up'", _MATCHES.format(f"created_s > {_AFTER_40}"))} {_BY_TIME}"""
)
def impact_of(spark, folder):
    return _nodes(_engine(spark, folder).impact_of("https://ex.test/d/40"))


_LOG = "select row_number() over (order by doc_id desc) as position, md5(cast(doc_id as {0})) sha from documents"


@query(
    f"""with {D}, log as ({_LOG.format("varchar")}), page as (select * from log order by position limit 20),
{walk_ctes("select 1 query_id, doc_id node, position pos from page join d on md5(cast(d.n as varchar)) = sha and d.type = 'commit'", T.DOC_EDGES, 1, admitted="select doc_id from d")}, {_found("seed", _ROLE)} {_BY_TIME}"""
)
def history_of(spark, folder):
    commits = T.view(spark, folder, "select doc_id, md5(cast(doc_id as string)) sha from documents")
    log = R.numbered(commits, [F.desc("doc_id")], name="position")
    return _nodes(_engine(spark, folder).history_of(log))


_WHY = [(10, 1), (25, 5), (40, 9), (41, 12)]


@query(
    f"""with {bm25_ctes(phrases=_phrases([(1, "the license of thing version moved")]))}, {knn_ctes(asked=_ONE_VECTOR)}, {RRF}, {LIFT},
{walk_ctes("select 1 query_id, doc_id node, x.a pos from d join (values " + ", ".join(map(str, _WHY)) + ") x(b, a) on b = n and type = 'commit'", T.DOC_EDGES, 3, admitted="select doc_id from d")},
{_found("blamed_commit", _ROLE, _MATCHES.format("true"))}
select node, role, hops::bigint hops, round(score, 6) score, row_number() over (order by score desc, created_s desc, node) as rank from found"""
)
def why(spark, folder):
    spans = T.view(spark, folder, "select doc_id n, md5(cast(doc_id as string)) sha from documents").join(F.broadcast(spark.createDataFrame(_WHY, "n int, line_start int")), "n")
    blame = spans.select("sha", "line_start", F.col("line_start").alias("line_end"), F.array(F.lit("x")).alias("lines"), F.when(F.col("n") == 10, F.lit("moved")).alias("subject"))
    return _nodes(_engine(spark, folder).why(blame, "version", "the license of thing"))


@query("select md5(case when length(text) <= 8000 then text else concat(substr(text, 1, 8000), chr(10), chr(10), '[truncated: 8,000 of ', format('{:,}', length(text)), ' characters shown.]') end) passage from documents where doc_id = 40")
def focus(spark, folder):
    doc = T.documents(spark, folder).where("n = 40").first().doc_id
    return spark.createDataFrame([(_engine(spark, folder).focus(doc, "the license of thing"),)], "t string").select(F.md5("t").alias("passage"))


# -- sources over derived payloads ------------------------------------------------------


def _payload(spark, folder, kind: str, fields: str, where: str = "true", table: str = "documents") -> DataFrame:
    """Rows of the documents as nodes of a service's answer."""
    return T.view(spark, folder, f"select '{kind}' kind, to_json(named_struct({fields})) value from {table} where {where}")


@query(
    """select concat('github:pr:o/r/pull/', doc_id) doc_id, 'github:o/r' repo_ref, concat('t', doc_id) title, 'ann' author, concat('ticket_key=PROJ-', doc_id % 9, '|pr_number=o/r#', doc_id + 1) refs, 1704067200 + doc_id * 60 updated_s from documents where doc_id % 2 = 0
union all select concat('github:commit:o/r/commit/', md5(cast(doc_id as varchar))), 'github:o/r', concat('c', doc_id), 'bob', concat('file_path=b', doc_id, '.py|file_path=a', doc_id, '.py|pr_number=o/r#', doc_id), 1704067200 + doc_id * 60 from documents where doc_id % 2 = 1
union all select concat('github:issue:o/r/issues/', doc_id), 'github:o/r', concat('i', doc_id), 'ann', '', 1704067200 + doc_id * 60 from documents where doc_id % 3 = 0
union all select concat('github:issue_comment:o/r/issues/', doc_id, '#issuecomment-', doc_id), 'github:o/r', concat('Comment on o/r#', doc_id), 'eve', concat('pr_number=o/r#', doc_id), 1704067200 + doc_id * 60 from documents where doc_id % 3 = 0"""
)
def github_documents(spark, folder):
    at = "date_format(timestamp_seconds(1704067200 + doc_id * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    who = lambda n: f"named_struct('login', '{n}')"
    prs = _payload(spark, folder, "prs", f"'slug', 'o/r', 'number', doc_id, 'title', concat('t', doc_id), 'body', concat('fixes PROJ-', doc_id % 9, ' and #', doc_id + 1), 'url', 'u', 'createdAt', {at}, 'updatedAt', {at}, 'headRefName', 'x', 'author', {who('ann')}", "doc_id % 2 = 0")
    commits = _payload(spark, folder, "commits", f"'slug', 'o/r', 'oid', md5(cast(doc_id as string)), 'url', 'u', 'messageHeadline', concat('c', doc_id), 'message', 'm', 'committedDate', {at}, 'authoredDate', {at}, 'author', named_struct('name', 'B', 'user', {who('bob')}), 'associatedPullRequests', named_struct('nodes', array(named_struct('number', doc_id))), 'files', array(named_struct('filename', concat('b', doc_id, '.py'), 'previous_filename', concat('a', doc_id, '.py')))", "doc_id % 2 = 1")
    said = f"named_struct('databaseId', doc_id, 'body', 'x', 'url', '', 'author', {who('eve')}, 'createdAt', {at}, 'updatedAt', {at})"
    issues = _payload(spark, folder, "issues", f"'slug', 'o/r', 'number', doc_id, 'title', concat('i', doc_id), 'body', '', 'url', 'u', 'createdAt', {at}, 'updatedAt', {at}, 'author', {who('ann')}, 'comments', named_struct('nodes', array({said}))", "doc_id % 3 = 0")
    return _flat(forge.github(spark, prs.union(commits).union(issues)))


def _flat(rows: DataFrame) -> DataFrame:
    refs = F.array_join(F.transform("refs", lambda r: F.concat(r["kind"], F.lit("="), r["value"])), "|")
    return rows.select("doc_id", "repo_ref", "title", "author", _by_kind(refs).alias("refs"), F.unix_seconds("updated_at").alias("updated_s"))


def _by_kind(refs):
    """References by kind, tickets first and numbers last, whatever the scanners' order is; those
    of a kind stay in their order."""
    kinds = ["ticket_key", "url", "commit_sha", "file_path", "pr_number"]
    parts = F.split(refs, r"\|")
    of = lambda kind: F.filter(parts, lambda r: r.startswith(f"{kind}="))
    return F.array_join(F.concat(*map(of, kinds)), "|")


@query(
    """select concat('gitlab:pr:g/p/pull/', doc_id) doc_id, 'gitlab:g/p' repo_ref, concat('m', doc_id) title, 'ann' author, concat('commit_sha=', md5(cast(doc_id as varchar)), '|pr_number=g/p#', doc_id + 2) refs, 1704067200 + doc_id * 60 updated_s from documents
union all select concat('gitlab:', case k when 0 then 'pr_review' else 'review_comment' end, ':g/p/pull/', doc_id, '#note_', doc_id * 10 + k), 'gitlab:g/p', concat(case k when 0 then 'Review on' else 'Review comment on' end, ' g/p!', doc_id, ': n', doc_id, '.py'), 'eve', concat('file_path=n', doc_id, '.py|pr_number=g/p#', doc_id), 1704067200 + doc_id * 60
from documents, (select unnest([0, 2]) k)"""
)
def gitlab_documents(spark, folder):
    at = "date_format(timestamp_seconds(1704067200 + doc_id * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    note = lambda k, system: f"named_struct('id', doc_id * 10 + {k}, 'body', 'x', 'system', {system}, 'author', named_struct('username', 'eve', 'name', 'E'), 'created_at', {at}, 'updated_at', {at}, 'position', named_struct('new_path', concat('n', doc_id, '.py'), 'old_path', concat('n', doc_id, '.py')))"
    merges = _payload(spark, folder, "merge_requests", f"'slug', 'g/p', 'iid', doc_id, 'title', concat('m', doc_id), 'description', concat('closes !', doc_id + 2), 'web_url', '', 'source_branch', 'x', 'author', named_struct('username', 'ann', 'name', 'A'), 'created_at', {at}, 'updated_at', {at}, 'commits', array(named_struct('id', md5(cast(doc_id as string)))), 'discussions', array(named_struct('individual_note', false, 'notes', array({note(0, 'false')}, {note(1, 'true')}, {note(2, 'false')})))")
    return _flat(forge.gitlab(spark, merges))


@query(
    """select concat('jira:ticket:AB-', doc_id) doc_id, '' repo_ref, concat('AB-', doc_id, ': s', doc_id) title, 'Ann' author, concat('ticket_key=AB-', doc_id + 1) refs, 1704067200 + doc_id * 60 - 3600 updated_s from documents
union all select concat('jira:ticket_comment:AB-', doc_id, '#', doc_id), '', concat('Comment on AB-', doc_id), 'Bob', concat('ticket_key=AB-', doc_id), 1704067200 + doc_id * 60 - 3600 from documents"""
)
def jira_documents(spark, folder):
    at = "date_format(timestamp_seconds(1704067200 + doc_id * 60), \"yyyy-MM-dd'T'HH:mm:ss'.000+0100'\")"
    tree = "to_json(named_struct('type', 'doc', 'content', array(named_struct('type', 'paragraph', 'content', array(named_struct('type', 'text', 'text', concat('see AB-', doc_id + 1, ' not AB-', doc_id)))))))"
    said = f"named_struct('id', cast(doc_id as string), 'body', cast(null as string), 'author', 'Bob', 'created', {at}, 'updated', {at})"
    rows = _payload(spark, folder, "tickets", f"'key', concat('AB-', doc_id), 'summary', concat('s', doc_id), 'description', {tree}, 'reporter', 'Ann', 'created', {at}, 'updated', {at}, 'comments', array({said})")
    return _flat(trackers.jira(spark, rows))


@query(
    """select concat('notion:page:', md5(cast(doc_id as varchar))) doc_id, '' repo_ref, concat('P', doc_id) title, '' author, concat('url=https://www.notion.so/', md5(cast(doc_id // 2 as varchar))) refs, 1704067200 + doc_id * 60 updated_s
from documents where doc_id % 4 <> 3 and list_contains([doc_id >> k for k in range(33)], 5)"""
)
def notion_documents(spark, folder):
    """Pages whose parent is the page of half the number, in the scope of page 5, not in the trash."""
    at = "date_format(timestamp_seconds(1704067200 + doc_id * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    half = "md5(cast(cast(floor(doc_id / 2) as bigint) as string))"
    properties = f"to_json(named_struct('Name', named_struct('id', 'a', 'type', 'title', 'title', array(named_struct('plain_text', concat('P', doc_id))), 'relation', cast(null as array<struct<id:string>>)), 'Up', named_struct('id', 'b', 'type', 'relation', 'title', cast(null as array<struct<plain_text:string>>), 'relation', array(named_struct('id', {half})))))"
    rows = _payload(spark, folder, "pages", f"'id', md5(cast(doc_id as string)), 'created_time', {at}, 'last_edited_time', {at}, 'url', 'u', 'in_trash', doc_id % 4 = 3, 'archived', false, 'parent', named_struct('type', 'page_id', 'page_id', {half}), 'properties', {properties}, 'blocks', '[]'")
    roots = spark.range(1).select(F.md5(F.lit("5")).alias("id"))
    return _flat(trackers.notion(spark, rows, roots=roots))


# -- the stored tables, in batches ------------------------------------------------------


def _store(spark, name: str) -> store.Tables:
    return store.Tables(spark, new_folder(spark, name), fan=3)


@query(
    f"""with {D} select doc_id, case when n % 4 = 3 then concat('newest ', n) when n % 4 = 2 then concat('newer ', n) else title end title,
  case n % 4 when 0 then 1 when 1 then 0 when 2 then 2 else 1 end::bigint parts from d"""
)
def stored_upserts(spark, folder):
    """Documents with their chunks in four batches, some of them again with other titles and with
    more, fewer or no chunks: the last state of each, with the number of its chunks."""
    tables, rows = _store(spark, "upserts"), T.documents(spark, folder)
    chunks = T.chunks(spark, folder).withColumn("thread_id", F.col("doc_id"))
    several = lambda some, k: some.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(*TABLES["chunks"].fieldNames())
    steps = [("true", None, 1), ("n % 4 >= 2", "newer", 3), ("n % 4 = 3", "newest", 1), ("n % 4 = 2", "newer", 2)]
    for test, word, k in steps:
        some = rows.where(test)
        with tables.transaction():
            tables.put("documents", some.withColumn("title", F.concat(F.lit(f"{word} "), "n")) if word else some)
            tables.put("chunks", several(chunks.where(test), k), some.select("doc_id"))
    tables.put("chunks", several(chunks.limit(0), 1), rows.where("n % 4 = 1").select("doc_id"))
    counted = tables.read("chunks").groupBy("doc_id").agg(F.count("*").alias("parts"))
    return tables.read("documents").join(counted, "doc_id", "left").select("doc_id", "title", F.coalesce("parts", F.lit(0)).cast("bigint").alias("parts"))


@query(f"with {D}, e as ({T.DOC_EDGES}) select src, dst, kind, max(case when md5(src) < '8' then 1.0 else conf end)::double confidence from e group by all")
def stored_edges(spark, folder):
    """Edges written three times, the middle one with lower confidences and the last one with higher
    ones for some: the highest of each stays, under both ends."""
    tables, rows = _store(spark, "edges"), T.edges(spark, folder, T.DOC_EDGES)
    for state in (rows, rows.withColumn("confidence", F.col("confidence") / 2), rows.where(F.md5("src") < "8").withColumn("confidence", F.lit(1.0))):
        tables.put("edges", state)
        tables.put("edges_in", state)
    return tables.read("edges").join(tables.read("edges_in"), ["src", "dst", "kind", "confidence"])


@query(SQL["link_edges"])
def link_batches(spark, folder):
    """The edges of :func:`link_edges`, linked as documents arrive, in two batches: a reference to a
    document of a later batch waits and is woken by it."""
    index, documents = L.LinkIndex(_store(spark, "links")), T.documents(spark, folder)
    refs = T.view(spark, folder, _LINK_REFS)
    for k in range(2):
        batch = documents.where(F.floor(F.col("n") / 3) % 2 == k)
        own = refs.join(batch.select(F.col("doc_id").alias("src_doc")), "src_doc", "left_semi")
        with index.tables.transaction():
            changed = index.arrived(batch)
            index.tables.put("documents", batch)
            index.link(own.unionByName(index.woken(changed)))
    return index.tables.read("edges")


@query(f"with {bm25_ctes()} {_LEX}")
def index_updates(spark, folder):
    """The best chunks by an index that has been made with other texts for a third of the
    documents, and then updated. Vectors take no part in it."""
    chunks = T.texts(spark, folder).withColumn("thread_id", F.col("doc_id")).withColumn("embedding", F.lit(None).cast("array<float>"))
    third = F.col("n") % 3 == 1
    earlier = chunks.withColumn("text", F.when(third, F.concat(F.lit("license of "), F.reverse("text"))).otherwise(F.col("text")))
    index = S.StoredIndex(_store(spark, "index"))
    for some in (earlier, chunks.where(third)):
        index.update(some, some.select("doc_id"))
    return _scored(S.bm25(index.index(), asked(spark)))


@query(f"with {D} select doc_id from d where created_s >= {SINCE} + 86400 and created_s <= {UNTIL} and type = 'pr'")
def window_overlap(spark, folder):
    """Chunks of a filter's own window narrowed by another one, whose later end doesn't widen it."""
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    where = S.Filters(doc_type="pr", since=at(SINCE), until=at(UNTIL)).within(at(SINCE + 86400), at(UNTIL + 86400)).within(None, None)
    return T.chunks(spark, folder).where(where.column()).select("doc_id")
