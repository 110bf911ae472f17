"""Incremental sync: one streaming query a source, whose batches are applied idempotently."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, embedding
from ..operators import link, store
from ..schema import TABLES

#: What a listener is told, in the order in which it happens (fixed values).
PHASES = ("round_started", "batch_stored", "chunks_indexed", "connector_finished", "pending_linked", "round_finished", "failed")


class Events:
    """The last ``room`` events of a sync; older ones are dropped."""

    def __init__(self, room: int = 64):
        self.room, self.items, self.seq = room, [], 0

    def tell(self, round_: int, source: str, phase: str, documents: int = 0, chunks: int = 0) -> None:
        if phase not in PHASES:
            raise ValueError(f"no phase {phase!r}")
        self.seq += 1
        self.items = [*self.items, (round_, self.seq, source, phase, documents, chunks)][-self.room :]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.items, "round int, seq int, source string, phase string, documents bigint, chunks bigint")


@dataclass(frozen=True)
class Source:
    """A stream of a service's nodes and what makes documents of a batch of them."""

    changes: DataFrame
    normalise: Callable[[DataFrame], DataFrame]


class LostLease(store.Precondition):
    """The round's lease has passed to another process."""


@dataclass
class Sync:
    """Applies batches of documents with references to stored tables. The order is: check, names,
    documents, chunks, links, cursor, all in one transaction, so that a batch is stored as a whole or
    not at all; and one that is delivered again changes nothing."""

    spark: SparkSession
    tables: store.Tables
    model: Callable = embedding.hashed
    width: int = 8
    identity: str = "hashed-8"
    chunk_format: str = "1"
    commit_files: DataFrame | None = None
    events: Events = field(default_factory=Events)
    round: int = 0
    lease: store.Lease | None = None

    def guard(self) -> None:
        """Before any source is touched: the store's vectors and chunks are of this kind."""
        meta = self.tables.read("meta")
        store.check_identity(meta, self.identity, self.chunk_format)
        for key, value in (("embedder_identity", self.identity), ("chunk_format", self.chunk_format)):
            meta = store.put_meta(meta, key, value)
        self.tables.write("meta", meta)

    def apply(self, batch: DataFrame, instance: str, now: datetime | None = None) -> None:
        """Of rows that repeat an id the last of the batch counts, by its column ``position`` if it
        has one, else by the time of change, and only its references are linked. What is read and
        written follows the batch: the parts of the stored tables that its ids and names fall into."""
        batch = batch.persist()
        with contextlib.ExitStack() as stack:
            stack.callback(batch.unpersist)
            stack.enter_context(self.tables.transaction())
            self._still_ours()
            link.check_instance(batch, instance)
            columns = [c for c in batch.columns if c not in ("refs", "position")]
            at = F.struct("updated_at", "created_at", F.xxhash64(*columns))
            order = F.struct(F.col("position"), at) if "position" in batch.columns else at
            latest = store.upsert_documents(batch.limit(0), batch.withColumn("_at", order), "_at").drop("position").persist()
            refs = latest.select(F.col("doc_id").alias("src_doc"), F.explode("refs").alias("r")).select("src_doc", "r.kind", "r.value", F.coalesce("r.instance", F.lit("")).alias("instance"))
            link.check_kinds(refs)
            rows, tables = latest.drop("refs"), self.tables
            changed = self.links.arrived(rows)
            tables.put("documents", rows)
            n = rows.count()
            self.events.tell(self.round, instance, "batch_stored", n)
            chunks = embedding.with_embeddings(chunking.chunk(rows), self.model, self.width).select(*TABLES["chunks"].fieldNames()).persist()
            if not chunks.where(F.size("embedding") != self.width).isEmpty():
                raise store.BadRequest(f"a chunk's vector isn't of width {self.width}")
            tables.put("chunks", chunks, rows.select("doc_id"))
            self.events.tell(self.round, instance, "chunks_indexed", n, chunks.count())
            chunks.unpersist()
            self.links.link(refs.unionByName(self.links.woken(changed)))
            mark = rows.agg(F.max(F.struct("updated_at", "doc_id")).alias("m")).first().m
            moment = now or datetime.now(timezone.utc).replace(microsecond=0)
            cursor = {"updated_at": f"{mark.updated_at:%Y-%m-%dT%H:%M:%SZ}", "doc_id": mark.doc_id}
            tables.put("cursors", self.spark.createDataFrame([(instance, cursor, moment)], TABLES["cursors"]))
            self._still_ours()

    @property
    def links(self) -> link.LinkIndex:
        return link.LinkIndex(self.tables, self.commit_files)

    def cursor(self, instance: str) -> dict[str, str] | None:
        """How far a source has been read, from the store: what a stream without a checkpoint of
        its own starts from."""
        row = self.tables.read("cursors").where(F.col("connector") == instance).first()
        return row and dict(row.payload)

    def _still_ours(self) -> None:
        if self.lease is not None and (self.lease.lost or not self.lease.heartbeat()):
            raise LostLease("another process has taken the store over")

    def follow(self, instance: str, options: dict[str, str], normalise: Callable[[DataFrame], DataFrame]) -> Source:
        """A remote source as one of a round: nodes that change, normalised batch by batch. Where
        its query has no checkpoint yet, it starts from the store's cursor."""
        known = self.cursor(instance)
        since = {"since": known["updated_at"]} if known else {}
        return Source(self.spark.readStream.format("remote").options(**since, **options).load(), normalise)

    def stream(self, changes: DataFrame | Source, instance: str, checkpoint: str, every: str | None = None, seen: list | None = None):
        """Starts the query of one source; its checkpoint is the cursor. Without ``every`` it
        ends when nothing is left."""
        normalise = None
        if isinstance(changes, Source):
            changes, normalise = changes.changes, changes.normalise

        def handle(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.apply(normalise(batch) if normalise else batch, instance)
                if seen is not None:
                    seen.append(number)

        writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def run(self, sources: dict[str, DataFrame | Source], checkpoints: str) -> dict[str, str] | None:
        """One round: sources one after another, each failing by itself; then what waits for a
        target is tried again. Returns the failures, or None without doing anything if another
        process holds the store; a round whose lease is lost ends there. The lease is renewed by a
        thread of its own, so that a long batch doesn't lose it."""
        if self.lease is not None and not self.lease.acquire():
            return None
        with contextlib.ExitStack() as stack:
            if self.lease is not None:
                stack.callback(self.lease.release)
                stack.enter_context(self.lease.kept())
            self.guard()
            self.round += 1
            self.events.tell(self.round, "", "round_started")
            failed = {}
            for instance, changes in sources.items():
                try:
                    self._still_ours()
                    while self._drain(changes, instance, f"{checkpoints}/{instance}"):
                        pass
                    self.events.tell(self.round, instance, "connector_finished")
                except Exception as e:  # noqa: BLE001  a source's failure leaves the others alone
                    if isinstance(e, LostLease) or "LostLease" in str(e):
                        self.events.tell(self.round, instance, "failed")
                        raise LostLease("another process has taken the store over") from e
                    failed[instance] = str(e)[:500]
                    self.events.tell(self.round, instance, "failed")
            self._still_ours()
            if self.commit_files is not None:
                self.links.relink()  # histories may have grown; all else has been woken by what arrived
            self.events.tell(self.round, "", "pending_linked")
            self.events.tell(self.round, "", "round_finished")
            return failed

    def every(self, sources: dict[str, DataFrame | Source], checkpoints: str, seconds: float = 1800.0, rounds: int | None = None, sleep=time.sleep) -> int:
        """Rounds on a schedule, the first after one interval; one that finds the store held is
        skipped. Returns how many ran."""
        ran, n = 0, 0
        while rounds is None or n < rounds:
            sleep(seconds)
            n += 1
            ran += self.run(sources, checkpoints) is not None
        return ran

    def _drain(self, changes: DataFrame | Source, instance: str, checkpoint: str) -> int:
        """Runs a source's query to its end; a simple reader offers one batch a run. Returns the
        number of batches that had rows."""
        seen: list[int] = []
        self.stream(changes, instance, checkpoint, seen=seen).awaitTermination()
        return len(seen)

    def reembed(self) -> None:
        """Forgets chunks and cursors and takes this model's identity; the next round, with new
        checkpoint folders, reads all sources again."""
        self.tables.wipe_chunks()
        self.tables.write("cursors", self.spark.createDataFrame([], TABLES["cursors"]))
        meta = self.tables.read("meta").where(~F.col("key").isin("embedder_identity", "chunk_format"))
        for key, value in (("embedder_identity", self.identity), ("chunk_format", self.chunk_format)):
            meta = store.put_meta(meta, key, value)
        self.tables.write("meta", meta)
