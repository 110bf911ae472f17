"""The test tables seen as the model's tables: plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXT = """case {n} % 5 when 0 then concat('acme/app/commit/', md5(cast({n} as string))) when 1 then concat('acme/app/pull/', {n})
 when 2 then concat('acme/app/issues/', {n}) when 3 then concat('p', {n}, '#c', {n} % 7) else concat('PROJ-', {n}) end"""
_TYPE = "case {n} % 5 when 0 then 'commit' when 1 then 'pr' when 2 then 'issue' when 3 then 'page' else 'ticket' end"
_ID = f"concat(case {{n}} % 2 when 0 then 'github' else 'jira' end, ':', {_TYPE}, ':', {_EXT})"


def doc_key(n: str) -> str:
    return _ID.format(n=n)


DOCS = f"""select doc_id n, {doc_key("doc_id")} doc_id, case doc_id % 2 when 0 then 'github' else 'jira' end source, {_TYPE.format(n="doc_id")} type,
 concat('repo', doc_id % 3) repo_ref, concat('Title ', doc_id) title, text body, concat('user', doc_id % 13) author,
 case when doc_id % 11 = 0 then '' else concat('https://ex.test/d/', doc_id) end url, 1704067200 + doc_id * 21600 created_s
from documents"""

DOC_EDGES = f"""select {doc_key("a")} src, {doc_key("b")} dst, kind, conf from (
 select doc_id a, cast(floor(doc_id / 2) as bigint) b, 'references_doc' kind, 0.9 conf from documents where doc_id > 0
 union all select doc_id a, doc_id + 7 b, 'pr_closes_issue' kind, 1.0 conf from documents where doc_id % 3 = 0
 union all select doc_id a, doc_id + 20 b, 'mentions_path' kind, 0.7 conf from documents where doc_id % 4 = 1
) x where b in (select doc_id from documents)"""

GRAPH = """select distinct src, dst, kind, conf from (
 select concat('o', o_orderkey) src, concat('c', o_custkey) dst, 'references_doc' kind, 0.9 conf from orders
 union all select concat('c', c_custkey) src, concat('n', c_nationkey) dst, 'pr_closes_issue' kind, 1.0 conf from customer
 union all select concat('n', n_nationkey) src, concat('r', n_regionkey) dst, 'commit_in_pr' kind, 1.0 conf from nation
 union all select concat('o', l_orderkey) src, concat('p', l_partkey) dst, 'mentions_path' kind, 0.7 conf from lineitem
) x"""

REFS = """select o_orderkey n, concat('fixes PROJ-', o_orderkey % 50, ' and PROJ-', o_orderkey % 50, ', see https://ex.test/c/', o_custkey, '. src/mod', o_custkey % 9,
 '/file.py at ', md5(cast(o_orderkey as string)), ' closes acme/app#', o_custkey, ' #', o_orderkey % 20, ' (https://ex.test/d/a.b/c.d)') t from orders"""

TABLES = ("documents", "embeddings", "events", "conversations", "pages", "labels", "benchmark", "orders", "customer", "lineitem", "part", "supplier", "nation", "region")


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``folder``, whose names in it are replaced by paths, so no
    view of the session is touched."""
    import re

    return spark.sql(re.sub(rf"(?<=from )({'|'.join(TABLES)})\b", lambda m: f"parquet.`{folder}/{m[1]}.parquet`", sql))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, DOCS)
    return rows.selectExpr("n", "doc_id", "source", "type", "repo_ref", "title", "body", "author", "url", "timestamp_seconds(created_s) created_at", "timestamp_seconds(created_s) updated_at")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk a document; those with a row in embeddings have its vector."""
    vectors = view(spark, folder, "select vec_id n, embedding from embeddings")
    rows = documents(spark, folder).join(vectors, "n", "left")
    return rows.selectExpr("n", "doc_id", "0 ordinal", "body text", "source", "repo_ref", "type doc_type", "author", "created_at", "updated_at", "embedding")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks without their vectors, so that no text is joined."""
    return documents(spark, folder).selectExpr("n", "doc_id", "0 ordinal", "body text", "source", "repo_ref", "type doc_type", "author", "created_at", "updated_at")


def edges(spark: SparkSession, folder: str, sql: str = GRAPH) -> DataFrame:
    return view(spark, folder, sql).selectExpr("src", "dst", "kind", "cast(conf as double) confidence")
