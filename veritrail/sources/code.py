"""Blame and history of a local clone as tables."""

from __future__ import annotations

import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

_HEAD = re.compile(r"^([0-9a-f]{40}) \d+ (\d+)")


def _git(repo: str, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", repo, *arguments], capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise RuntimeError(done.stderr.strip()[:500])
    return done.stdout


def blame_lines(text: str):
    """``(line, sha, author, time, subject, text)`` of porcelain output."""
    known: dict[str, dict] = {}
    sha, line = "", 0
    for row in text.split("\n"):
        if head := _HEAD.match(row):
            sha, line = head[1], int(head[2])
            known.setdefault(sha, {})
        elif row.startswith("\t"):
            about = known[sha]
            when = datetime.fromtimestamp(int(about.get("author-time", 0)), timezone.utc)
            yield line, sha, about.get("author", ""), when, about.get("summary", ""), row[1:]
        elif sha:
            key, _, value = row.partition(" ")
            known[sha].setdefault(key, value)


@udtf(returnType="line int, sha string, author string, time timestamp, subject string, text string")
class BlameLines:
    def eval(self, repo: str, path: str, first: int, last: int):
        yield from blame_lines(_git(repo, "blame", "--porcelain", "-L", f"{first},{last}", "HEAD", "--", path))


@udtf(returnType="position int, sha string, author string, time timestamp, subject string")
class LogRows:
    def eval(self, repo: str, path: str):
        out = _git(repo, "log", "--follow", "--format=%H%x00%an%x00%at%x00%s", "HEAD", "--", path)
        for n, row in enumerate(filter(None, out.split("\n"))):
            sha, author, when, subject = row.split("\0", 3)
            yield n + 1, sha, author, datetime.fromtimestamp(int(when), timezone.utc), subject


@udtf(returnType="tracked boolean")
class TrackedAtHead:
    def eval(self, repo: str, path: str):
        out = _git(repo, "ls-tree", "HEAD", "--", path)
        yield (any(row.split(None, 3)[1] == "blob" and row.split("\t", 1)[1] == path for row in out.split("\n") if row),)


def spans(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one commit: sha, line_start, line_end, author, time,
    subject, lines. Islands are numbered by the changes before them."""
    order = Window.orderBy("line")
    new = (F.lag("sha").over(order) != F.col("sha")) | (F.lag("line").over(order) != F.col("line") - 1)
    rows = lines.withColumn("island", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(order))
    out = rows.groupBy("island", "sha").agg(
        F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.first("author").alias("author"), F.first("time").alias("time"), F.first("subject").alias("subject"),
        F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"),
    )
    return out.drop("island").orderBy("line_start")


def blame(spark: SparkSession, repo: str, path: str, first: int, last: int | None = None) -> DataFrame:
    return spans(BlameLines(F.lit(repo), F.lit(path), F.lit(first), F.lit(last or first)))


def log(spark: SparkSession, repo: str, path: str) -> DataFrame:
    return LogRows(F.lit(repo), F.lit(path))


def tracked(spark: SparkSession, repo: str, path: str) -> Column | bool:
    return TrackedAtHead(F.lit(repo), F.lit(path)).first().tracked
