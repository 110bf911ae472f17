"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import language, near_duplicates, packing, pii, toxicity
from veritrail.llm.common import dropped, new_folder
from veritrail.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known (operator 5). Null and letterless texts go; repeated rows
    go or stay together, an empty table stays empty, other columns pass through."""
    return language.with_language(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic (operator 8), by the text alone: null ids, repeated rows and
    other columns make no difference; an empty table stays empty."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (operator 10);
    of rows of a group that repeat that id, or of a group without ids, one. Rows are joined
    on the id and the text's digest, so an id's other texts don't come back, and a hot
    source, a large group of copies or many rows without an id make no hot task."""
    digest = F.unhex(F.md5("text"))
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text", digest.alias("_digest")), carried=("_digest",)).where("kept")
    one = found.groupBy(F.col("doc_id").alias("_id"), F.coalesce("root", "_digest").alias("_group")).agg(F.min("_digest").alias("_kept"))
    rows = docs.withColumn("_digest", digest)
    kept = rows.join(one, rows["doc_id"].eqNullSafe(one["_id"]) & rows["_digest"].eqNullSafe(one["_kept"]), "inner")
    return kept.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind (operator 7), in the text alone; null and empty texts stay, rows
    are independent of each other, an empty table stays empty."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences (operator 2): a row for each piece, a null text being an empty
    one of one token; repeated rows are packed as often as they come, other columns are ignored, an empty table gives no pieces."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("pii", pii_redaction),
    ("packing", best_fit_packing),
]

#: SQL can't express the models, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder
    as Parquet and read again, so a lost executor costs no more than a stage. A stage's folder is
    removed once the next one's is written; the last one's stays for whoever reads the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        dropped(spark, before)
        before = folder
    return docs
