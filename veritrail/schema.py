"""Schemas of the stored tables and the constants that bound a query."""

from __future__ import annotations

from pyspark.sql import types as T

REF = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "instance")])

DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "source", "type", "repo_ref", "title", "body", "author", "url")]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")]
)
DOCUMENT_WITH_REFS = T.StructType([*DOCUMENT.fields, T.StructField("refs", T.ArrayType(REF))])

CHUNK = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("ordinal", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "source", "repo_ref", "doc_type", "author")]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")]
    + [T.StructField("thread_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "dst", "kind")] + [T.StructField("confidence", T.DoubleType())])
PENDING = T.StructType([T.StructField(n, T.StringType()) for n in ("src_doc", "kind", "value", "instance")])
CURSOR = T.StructType([T.StructField("connector", T.StringType()), T.StructField("payload", T.MapType(T.StringType(), T.StringType())), T.StructField("updated_at", T.TimestampType())])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

LOOKUP_KEY = T.StructType([T.StructField(n, T.StringType()) for n in ("shape", "key", "doc_id", "source", "type")])
WAITING = T.StructType([T.StructField(n, T.StringType()) for n in ("shape", "key")] + PENDING.fields)

POSTING = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("dl", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "repo_ref", "doc_type")] + [T.StructField("created_at", T.TimestampType())]
)
WORD = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
CORPUS = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.LongType())])

#: ``edges_in`` holds the edges again, dealt by their targets; ``keys`` every way to name a
#: document, and ``waiting`` pending references by the names that they wait for.
TABLES = {
    "documents": DOCUMENT, "chunks": CHUNK, "edges": EDGE, "edges_in": EDGE, "pending_refs": PENDING,
    "keys": LOOKUP_KEY, "waiting": WAITING, "postings": POSTING, "words": WORD, "corpus": CORPUS, "cursors": CURSOR, "meta": META,
}
SCHEMA_VERSION = "1"

REF_KINDS = ("url", "ticket_key", "commit_sha", "file_path", "pr_number")
EDGE_KINDS = ("commit_in_pr", "pr_closes_issue", "references_doc", "mentions_commit", "mentions_path", "supersedes")

# Fixed values that results depend on.
TOP_K = 12
RRF_K = 60
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
WALK_DEPTH, WALK_FLOOR, TRACE_DEPTH = 3, 0.3, 2
HOP_DECAY, RECENCY_PENALTY, RECENCY_DAYS = 0.6, 0.2, 365
EVENT_WINDOW_DAYS, EVENT_CANDIDATES = 30, 5
PASSAGES = 3
HISTORY_DEFAULT, HISTORY_CAP, PATH_COMMITS = 20, 50, 50
MAX_CHAINS = 64
EXCERPT_BYTES, BODY_CHARACTERS = 500, 8000
CHUNK_MIN_BYTES, CHUNK_MAX_BYTES, CHUNK_OVERLAP_BYTES = 1200, 2000, 200
