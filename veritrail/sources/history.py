"""Histories of clones: what each commit changed, as a partitioned source, and the commits of each
path through its renames, as joins."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..session import settled

#: Commits of a clone that one task reads.
RANGE = 5000
CHANGES = "repo string, position bigint, sha string, time timestamp, status string, path string, old_path string"


def _git(repo: str, *arguments: str) -> str | None:
    """What git says, or nothing if it can't read the clone."""
    done = subprocess.run(["git", "-C", repo, *arguments], capture_output=True, timeout=600)
    return None if done.returncode else done.stdout.decode("utf-8", "replace")


def changes_of(text: str, repo: str, first: int):
    """Rows of CHANGES from a log with zero bytes between its parts: a mark, the hash and the time
    of a commit, then a letter and one path for each change, or two paths for a rename."""
    position, sha, time = first, "", None
    parts = iter(text.split("\0"))
    for part in parts:
        part = part.lstrip("\n")
        if part.startswith("\x01"):
            position += 1
            sha, seconds = part[1:].split(" ")
            time = datetime.fromtimestamp(int(seconds), timezone.utc)
        elif part:
            old = next(parts) if part[0] in "RC" else None
            yield repo, position, sha, time, part[0], next(parts), old


class Clones(DataSource):
    """``spark.read.format("clone")``: option ``paths`` are clones, comma between, in folders that all
    executors see, ``range`` the commits of a partition. A clone that can't be read has no rows, so
    references to its paths go on waiting."""

    @classmethod
    def name(cls) -> str:
        return "clone"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size = [p for p in options["paths"].split(",") if p], int(options.get("range", RANGE))

    def partitions(self):
        out = []
        for path in self.paths:
            n = int(_git(path, "rev-list", "--count", "HEAD") or 0)
            out += [InputPartition((path, at)) for at in range(0, n, self.size)]
        return out

    def read(self, partition):
        path, at = partition.value
        text = _git(path, "log", "-M", "--name-status", "-z", "--format=%x01%H %at", f"--skip={at}", f"--max-count={self.size}", "HEAD")
        yield from changes_of(text or "", path, at)


def tracked(changes: DataFrame) -> DataFrame:
    """``repo, path`` of the files that the newest commit has: the last thing that happened to them
    isn't that they were deleted or renamed to something else."""
    here = changes.select("repo", "path", "position", (F.col("status") != "D").alias("there"))
    away = changes.where("status = 'R'").select("repo", F.col("old_path").alias("path"), "position", F.lit(False).alias("there"))
    newest = here.unionByName(away).groupBy("repo", "path").agg(F.min(F.struct("position", (~F.col("there")).alias("lost"))).alias("last"))
    return newest.where("not last.lost").select("repo", "path")


def episodes(changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``repo, path, name, since, until``: which name a path of the newest commit had, for the
    commits at positions after ``since`` up to ``until``, which is null for its first name.

    A rename is followed by the nearest older one to the name that it took away, which one
    sorted pass finds. A path's renames are then gathered by pointers that double: each round
    adds to what is known of a path the renames as many steps further on, and joins the
    pointers with themselves, so a file of n names takes log n rounds of joins on unique keys."""
    event = ["repo", "name", "pos"]
    renames = changes.where("status = 'R'").groupBy("repo", F.col("path").alias("name"), F.col("position").alias("pos")).agg(F.min("old_path").alias("old"))
    begun = tracked(changes) if paths is None else tracked(changes).join(paths.select("path").distinct(), "path", "left_semi")
    asked = renames.select("repo", F.col("old").alias("name"), "pos", F.col("name").alias("of"), F.lit(None).cast("bigint").alias("arrival"))
    heads = begun.select("repo", F.col("path").alias("name"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("of"), F.lit(None).cast("bigint").alias("arrival"))
    arrivals = renames.select("repo", "name", "pos", F.lit(None).cast("string").alias("of"), F.col("pos").alias("arrival"))
    older = Window.partitionBy("repo", "name").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)  # a running minimum from the oldest on
    met = settled(asked.unionByName(heads).unionByName(arrivals).withColumn("next", F.min("arrival").over(older)).where("arrival is null"))
    first = met.where("of is null").select("repo", F.col("name").alias("path"), F.col("next").alias("pos"))
    every = met.where("of is not null").select("repo", F.col("of").alias("name"), "pos", F.col("name").alias("old"), "next")
    jump = every.where("next is not null").select(*event, F.col("old").alias("to"), F.col("next").alias("at"))
    known = first.where("pos is not null").select("repo", "path", F.col("path").alias("name"), "pos")
    while True:
        further = settled(known.join(jump, event).select("repo", "path", F.col("to").alias("name"), F.col("at").alias("pos")))
        if further.isEmpty():
            break
        known = settled(known.unionByName(further))
        again = jump.select("repo", F.col("name").alias("to"), F.col("pos").alias("at"), F.col("to").alias("to2"), F.col("at").alias("at2"))
        jump = settled(jump.join(again, ["repo", "to", "at"]).select(*event, F.col("to2").alias("to"), F.col("at2").alias("at")))
    now = first.select("repo", "path", F.col("path").alias("name"), F.lit(0).cast("bigint").alias("since"), F.col("pos").alias("until"))
    before = known.join(every, event).select("repo", "path", F.col("old").alias("name"), F.col("pos").alias("since"), F.col("next").alias("until"))
    return now.unionByName(before)


def commit_files(changes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``repo, path, sha, time, position``: the commits that touch each path of the newest commit
    (of ``paths`` (path), if they are given), under the names that it had then; newest first
    by position. A commit that renames a file touches both names. It is what :func:`veritrail.operators.link.link` takes.

    An episode ends at the nearest rename to its name, and so does the stretch of a name's
    commits that a commit lies in; both are joined on that end, so a name that is taken
    again and again is cut into its stretches and not paired with all its episodes. A commit
    lies in one episode of a path, hence in one row."""
    named = episodes(changes, paths).withColumn("until", F.coalesce("until", F.lit(0)))
    about = ["repo", "sha", "time", "position"]
    away = changes.where("status = 'R'").select(*about, F.col("old_path").alias("name"), F.lit(False).alias("arrives"))
    here = changes.select(*about, F.col("path").alias("name"), (F.col("status") == "R").alias("arrives"))
    touched = here.unionByName(away).groupBy(*about, "name").agg(F.max("arrives").alias("arrives"))
    older = Window.partitionBy("repo", "name").orderBy(F.desc("position")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = touched.withColumn("until", F.coalesce(F.min(F.when(F.col("arrives"), F.col("position"))).over(older), F.lit(0)))
    return ended.join(named, ["repo", "name", "until"]).where("position > since").select("repo", "path", "sha", "time", "position")
