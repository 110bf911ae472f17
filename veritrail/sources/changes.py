"""Change streams: a Python data source over recorded batches, frames of an external process,
cursor tests, and a retrying transport."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.store import BadRequest
from ..schema import DOCUMENT_WITH_REFS

BATCH, RANGE = 50, 32 << 20
LINE_BYTES = 8 << 20
FRAME = "type string, documents array<struct<doc_id:string,source:string,type:string,repo_ref:string,title:string,body:string,author:string,url:string,created_at:timestamp,updated_at:timestamp,refs:array<struct<kind:string,value:string,instance:string>>>>, cursor map<string,string>"


def after_cursor(rows: DataFrame, updated_at, doc_id: str | None, tie_type: str = "commit") -> DataFrame:
    """What a cursor leaves to deliver: later in (time, id); commits at the cursor's very time
    come again, since several may share it. No cursor: everything."""
    if updated_at is None:
        return rows
    mark = F.struct(F.lit(updated_at).cast("timestamp").alias("updated_at"), F.lit(doc_id or "").alias("doc_id"))
    again = (F.col("type") == tie_type) & (F.col("updated_at") >= F.lit(updated_at))
    return rows.where((F.struct("updated_at", "doc_id") > mark) | again)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an external source's output, a frame a line: batches with a cursor each,
    then done. A batch without a cursor, one within done, or an unknown frame is refused."""
    lines = spark.read.text(path)
    if not lines.where(F.octet_length("value") > LINE_BYTES).isEmpty():
        raise BadRequest(f"a frame is longer than {LINE_BYTES} bytes")
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", FRAME).alias("f")).select("f.*")
    empty = F.size(F.coalesce(F.map_keys("cursor"), F.array().cast("array<string>"))) == 0
    wrong = F.coalesce(~F.col("type").isin("batch", "done"), F.lit(True)) | ((F.col("type") == "batch") & empty) | ((F.col("type") == "done") & (F.size(F.coalesce("documents", F.array().cast(rows.schema["documents"].dataType))) > 0))
    if not rows.where(wrong).isEmpty():
        raise BadRequest("a frame isn't a batch with a cursor or a bare done")
    return rows.where("type = 'batch'").select(F.inline("documents")).to(DOCUMENT_WITH_REFS)


def batches(rows: list[dict], size: int = BATCH, whole_times: bool = False) -> Iterator[list[dict]]:
    """Rows in order, in batches of about ``size``; with ``whole_times`` a batch never ends
    between rows of one time."""
    held: list[dict] = []
    for row in rows:
        full = len(held) >= size
        if full and not (whole_times and held[-1]["updated_at"] == row["updated_at"]):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _parsed(lines) -> list[dict]:
    return [json.loads(line) for line in lines if line.strip()]


def _between(path: str, low: int, high: int) -> Iterator[bytes]:
    """The lines of a file that begin in a range of its bytes."""
    with open(path, "rb") as f:
        f.seek(max(0, low - 1))
        if low:
            f.readline()  # the line that the range before has begun, or its last line's end
        while f.tell() < high and (line := f.readline()):
            yield line


class _Ordered:
    """A recorded file's documents in order of (time, id), parsed again only when it has changed."""

    def __init__(self, path: str):
        self.path, self.seen, self.rows = path, None, []

    def __call__(self) -> list[dict]:
        stat = os.stat(self.path)
        if (stat.st_mtime_ns, stat.st_size) != self.seen:
            with open(self.path, encoding="utf-8") as f:
                self.rows = sorted(_parsed(f), key=lambda r: (r["updated_at"], r["doc_id"]))
            self.seen = (stat.st_mtime_ns, stat.st_size)
        return self.rows


def _tuple(row: dict) -> tuple:
    from datetime import datetime

    refs = [(r["kind"], r["value"], r.get("instance", "")) for r in row.get("refs", [])]
    times = [datetime.fromisoformat(row[k].replace("Z", "+00:00")) for k in ("created_at", "updated_at")]
    return (*(row.get(k, "") for k in ("doc_id", "source", "type", "repo_ref", "title", "body", "author", "url")), *times, refs)


class RecordedChanges(DataSource):
    """``spark.read`` or ``readStream`` with format ``changes``: option ``path`` is a file of
    documents, ``batch`` the size of a batch. An offset is (time, id) of the last row, so a
    restart delivers what came after it; a stream that fails loses no batch that it hasn't
    committed. A batch read deals ranges of ``range`` bytes to tasks, each of which reads its
    own range alone; so the path has to be one that all executors see. The stream's reader
    runs on the driver, as the interface has it, and parses a file again only when it grows."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self):
        return DOCUMENT_WITH_REFS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("range", RANGE))

    def partitions(self):
        n = os.stat(self.path).st_size
        return [InputPartition((at, min(n, at + self.size))) for at in range(0, n, self.size)]

    def read(self, partition):
        yield from map(_tuple, _parsed(_between(self.path, *partition.value)))


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.ordered, self.size = _Ordered(options["path"]), int(options.get("batch", BATCH))

    def initialOffset(self) -> dict:
        return {"updated_at": "", "doc_id": ""}

    def _after(self, start: dict) -> list[dict]:
        return [r for r in self.ordered() if (r["updated_at"], r["doc_id"]) > (start["updated_at"], start["doc_id"])]

    def read(self, start: dict):
        rows = next(batches(self._after(start), self.size, whole_times=True), [])
        end = {k: rows[-1][k] for k in ("updated_at", "doc_id")} if rows else start
        return iter([_tuple(r) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict):
        stop = (end["updated_at"], end["doc_id"])
        return iter([_tuple(r) for r in self._after(start) if (r["updated_at"], r["doc_id"]) <= stop])

    def commit(self, end: dict) -> None:
        pass


class Transient(Exception):
    """A failure worth another try; ``retry_after`` in seconds if the service names one."""

    def __init__(self, message: str, retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def retrying(call: Callable, attempts: int = 4, first: float = 0.5, most: float = 8.0, longest_wait: float = 60.0, sleep=time.sleep):
    """Calls until it works: waits double up to ``most``, half of each at random; a wait that
    the service asks for is kept up to ``longest_wait``."""
    for n in range(attempts):
        try:
            return call()
        except Transient as e:
            if n == attempts - 1:
                raise
            wait = min(most, first * 2**n)
            sleep(min(e.retry_after, longest_wait) if e.retry_after is not None else wait / 2 + random.uniform(0, wait / 2))


def pages(fetch: Callable[[str | None], tuple[list, str | None]]) -> Iterator:
    """Items of a paged interface: ``fetch(token)`` gives items and the next token."""
    token = None
    while True:
        items, token = fetch(token)
        yield from items
        if not token:
            return


def watermark_stop(rows: DataFrame, updated_at: Column | object) -> DataFrame:
    """The part of newest-first pages that an early stop at the watermark reads, ties kept."""
    return rows.where(F.col("updated_at") >= updated_at)
