"""Upserts, deletes and counts of the stored tables.

A table is a DataFrame; an operator returns its next state. Parquet has no MERGE, so a stored
table is a list of segments that are merged on read (:class:`Tables`).
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import TABLES


class Precondition(Exception):
    """The store or the request isn't in a state that allows this."""


class BadRequest(Exception):
    """The request makes no sense."""


class NotFound(Exception):
    """What was asked for isn't in the store."""


class Unciteable(NotFound):
    """What was asked for is known but can't be cited, so nothing else may stand in for it."""


def upsert_documents(stored: DataFrame, batch: DataFrame, position: str | None = None) -> DataFrame:
    """Last write wins by doc_id; within a batch the row with the highest ``position``."""
    if position:
        order = Window.partitionBy("doc_id").orderBy(F.desc(position))
        batch = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    else:
        batch = batch.dropDuplicates(["doc_id"])
    return stored.join(batch, "doc_id", "left_anti").unionByName(batch.select(*stored.columns))


def derived(documents: DataFrame) -> DataFrame:
    """With what lookups use: external_key and sha_prefix."""
    return documents.withColumn("external_key", X.external_id(F.col("doc_id"))).withColumn("sha_prefix", X.sha_prefix(F.col("doc_id"), F.col("type")))


def replace_chunks(stored: DataFrame, touched: DataFrame, chunks: DataFrame, documents: DataFrame, width: int | None = None) -> DataFrame:
    """All chunks of the documents in ``touched`` (doc_id) give way to ``chunks``; a document
    with none is cleared. Wrong vector widths and chunks without a document are refused."""
    if width is not None and not chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != width)).isEmpty():
        raise BadRequest(f"a chunk's vector isn't of width {width}")
    if not chunks.join(documents, "doc_id", "left_anti").isEmpty():
        raise BadRequest("a chunk's document isn't stored")
    return stored.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(chunks.select(*stored.columns))


def upsert_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The highest confidence of each (src, dst, kind), whatever the order of writes."""
    return stored.unionByName(batch).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def add_pending(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.unionByName(batch.select(*stored.columns)).distinct()


def remove_pending(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    return stored.join(resolved.select(*stored.columns), stored.columns, "left_anti")


def put_cursor(stored: DataFrame, connector: str, payload: dict[str, str], now: datetime) -> DataFrame:
    row = stored.sparkSession.createDataFrame([(connector, payload, now)], stored.schema)
    return stored.where(F.col("connector") != connector).unionByName(row)


GUARDED_META = ("schema_version", "vector_dims")


def put_meta(stored: DataFrame, key: str, value: str) -> DataFrame:
    if key in GUARDED_META:
        raise BadRequest(f"{key} is set when a store is made")
    row = stored.sparkSession.createDataFrame([(key, value)], stored.schema)
    return stored.where(F.col("key") != key).unionByName(row)


def check_identity(meta: DataFrame, identity: str, chunk_format: str) -> None:
    """Refuses a store whose vectors or chunks another model or format has made."""
    known = {r.key: r.value for r in meta.where(F.col("key").isin("embedder_identity", "chunk_format")).collect()}
    for key, value in (("embedder_identity", identity), ("chunk_format", chunk_format)):
        if known.get(key, value) != value:
            raise Precondition(f"the store's {key} is {known[key]!r}, not {value!r}; embed it again")


def by_id(documents: DataFrame, ids: DataFrame, body: bool = False) -> DataFrame:
    """Documents of an id list; unknown ids are left out."""
    columns = [c for c in documents.columns if body or c != "body"]
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*columns)


def counts(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, chunks, edges."""
    parts = [t.agg(F.count("*").alias(n)) for t, n in ((documents, "documents"), (chunks, "chunks"), (edges, "edges"))]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # each is one row


def per_source(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.count("*").alias("documents"))


def source_status(documents: DataFrame, cursors: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``source, documents, checkpoint_at, configured``: every source that has documents, a
    checkpoint or a declaration."""
    marks = cursors.select(F.col("connector").alias("source"), F.col("updated_at").alias("checkpoint_at"))
    out = per_source(documents).join(marks, "source", "full_outer")
    if declared is None:
        out = out.withColumn("configured", F.lit(False))
    else:
        named = declared.select("source").distinct().withColumn("configured", F.lit(True))
        out = out.join(named, "source", "full_outer")
    return out.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), "checkpoint_at", F.coalesce("configured", F.lit(False)).alias("configured"))


def ages(rows: DataFrame, now: datetime, column: str = "checkpoint_at") -> DataFrame:
    """Adds whole seconds since a time."""
    return rows.withColumn("age_seconds", F.unix_timestamp(F.lit(now)) - F.unix_timestamp(column))


def running_totals(events: DataFrame) -> DataFrame:
    """Cumulative documents and chunks of each round in order of events."""
    order = Window.partitionBy("round").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("round", "seq", F.sum("documents").over(order).alias("documents"), F.sum("chunks").over(order).alias("chunks"))


@dataclass(frozen=True)
class Layout:
    """How a table is kept: the columns whose hash deals its rows, and the unit of which a later
    write replaces all rows, or keeps the ``highest`` or the sum (``added``) of a column. Keys that hold more
    rows than a part should are ``spread`` over all parts by another column; rows of such a table, of which there are
    many small ones, are dealt in blocks. A part is ``packed`` times smaller where rows take so much more of the
    memory that sorts them than of the file."""

    key: tuple[str, ...]
    unit: tuple[str, ...]
    highest: str | None = None
    added: str | None = None
    spread: str | None = None
    packed: int = 1

    @property
    def merged(self):
        """The aggregate of a unit's rows, if it isn't replaced by later ones."""
        if self.highest:
            return F.max(self.highest).alias(self.highest)
        return F.sum(self.added).alias(self.added) if self.added else None


_REFERENCE = ("src_doc", "kind", "value", "instance")
LAYOUTS = {
    "documents": Layout(("doc_id",), ("doc_id",)),
    "chunks": Layout(("doc_id",), ("doc_id",)),
    "edges": Layout(("src",), ("src", "dst", "kind"), "confidence"),
    "edges_in": Layout(("dst",), ("src", "dst", "kind"), "confidence"),
    "pending_refs": Layout(("src_doc",), _REFERENCE),
    "keys": Layout(("shape", "key"), ("shape", "key", "doc_id")),
    "waiting": Layout(("shape", "key"), ("shape", "key", *_REFERENCE)),
    "postings": Layout(("term",), ("term", "doc_id"), spread="doc_id", packed=16),
    "words": Layout(("term",), ("term",), added="df"),
    "corpus": Layout(("name",), ("name",), added="value"),
    "cursors": Layout(("connector",), ("connector",)),
    "meta": Layout(("key",), ("key",)),
}
#: Bits of a row's hash that are stored with it; a segment has at most so many parts.
BITS = 20
#: Bytes of a segment's part, about; a segment has a power of two of them.
PART_BYTES = 128 << 20
#: Bytes of what is put down as it comes that a task reads to deal it, and of its row groups, which aren't split.
RAW_BYTES = 8 << 20
#: Bytes of rows that a task turns into blocks at a time.
BLOCK_BYTES = 64 << 20
#: How segments are compressed.
CODEC = "zstd"
#: Segments of one size that are merged into one of the next; a size is FAN times the last.
FAN, SMALL_BYTES = 8, 1 << 20
#: The last line of a manifest; one without it is being written, or after so many seconds its writer has died.
END, UNFINISHED = "end", 60
#: Up to so many hashes a read tests rows, beyond it parts alone; either way it gives all that was asked.
TESTED = 4096


@dataclass(frozen=True)
class Segment:
    """A folder of rows that one write or merge has made: ``parts`` sub-folders by the low bits of
    the hash, the number of the manifest that it is as new as, its bytes and its size class."""

    folder: str
    number: int
    parts: int
    bytes: int
    tier: int

    def line(self) -> str:
        return f"{self.number} {self.parts} {self.bytes} {self.tier} {self.folder}"

    @staticmethod
    def of(line: str) -> Segment:
        number, parts, size, tier, folder = line.split(" ", 4)
        return Segment(folder, int(number), int(parts), int(size), int(tier))


def _blocks(batches):
    """Rows with ``part`` as compressed blocks of those of a part, in which each text stands once: rows by
    themselves repeat what many of them have in common, and take about twice the bytes."""
    import numpy as np
    import pyarrow as pa

    def packed(some):
        table = pa.Table.from_batches(some).combine_chunks()
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        table, part = table.take(pa.array(order)), part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        made = []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            rows = table.slice(a, b - a)
            for i, field in enumerate(table.schema):
                if pa.types.is_string(field.type) or pa.types.is_large_string(field.type):
                    rows = rows.set_column(i, field.name, rows.column(i).dictionary_encode())
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, rows.schema) as stream:
                stream.write_table(rows)
            made.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(made, pa.binary())], names=["part", "block"])

    some, size = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield packed(some)
            some, size = [], 0
    if some:
        yield packed(some)


def _of_blocks(batches):
    import pyarrow as pa

    for batch in batches:
        for block in batch.column("block"):
            with pa.CompressedInputStream(pa.BufferReader(block.as_buffer()), "zstd") as source:
                for rows in pa.ipc.open_stream(source):
                    columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in rows.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)


class Tables:
    """Stored tables on any file system that Spark reaches, as segments that are merged on read.

    A write adds a segment with the rows it was given and marks for what it removes, and a small
    manifest that lists the segments of all tables, so a batch costs its own bytes, whatever the table holds,
    and readers never see a half-written state. A read takes the newest rows of each unit; a read
    for some keys opens the parts that their hashes fall into, and tests the sorted hash column
    within. FAN segments of a size are merged into one of the next size, dealt to as many parts
    as its bytes ask for; so a row is rewritten a logarithmic number of times, parts double as a
    table grows, and a table has a logarithmic number of segments. Manifests are numbered; the
    highest counts, every read looks for it, and creating one fails if another writer has made
    it. :meth:`vacuum` removes folders that no manifest names any more.
    """

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN, part_bytes: int = PART_BYTES):
        self.spark, self.root, self.fan, self.part_bytes = spark, root.rstrip("/"), fan, part_bytes
        self._open: tuple[int, dict[str, list[Segment]]] | None = None

    # -- files ------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _size(self, folder: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def _manifest(self) -> tuple[int, dict[str, list[Segment]]]:
        """The newest manifest's number, and the segments of each table, oldest first, by the newest
        one that its writer has finished."""
        if self._open is not None:
            return self._open
        path, system = self._path("_manifests")
        files = sorted(system.listStatus(path), key=lambda f: f.getPath().getName(), reverse=True) if system.exists(path) else []
        for file in files:
            lines = self._lines(system, file.getPath())
            if lines and lines[-1] == END:
                found: dict[str, list[Segment]] = {}
                for name, rest in (line.split(" ", 1) for line in lines[:-1]):
                    found.setdefault(name, []).append(Segment.of(rest))
                return int(files[0].getPath().getName()), found
        return int(files[0].getPath().getName()) if files else 0, {}

    def _lines(self, system, path) -> list[str]:
        stream = system.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def state(self, name: str) -> tuple[int, list[Segment]]:
        number, found = self._manifest()
        return number, found.get(name, [])

    def _commit(self, number: int, tables: dict[str, list[Segment]]) -> None:
        if self._open is not None:
            self._open = (self._open[0], tables)
            return
        last, _ = self._path("_manifests", f"{number - 1:012d}")
        path, system = self._path("_manifests", f"{number:012d}")
        if number > 1 and self._lines(system, last)[-1:] != [END] and time.time() - system.getFileStatus(last).getModificationTime() / 1000 < UNFINISHED:
            raise Precondition("another writer is changing the store")
        try:
            out = system.create(path, False)
        except Exception as e:  # the file system's own exception: the manifest is there
            raise Precondition("another writer changed the store") from e
        out.write(bytearray("".join(f"{name} {s.line()}\n" for name, some in sorted(tables.items()) for s in some).encode() + END.encode()))
        out.close()

    def _replace(self, name: str, segments: list[Segment]) -> None:
        number, tables = self._manifest()
        self._commit(number + 1, tables | {name: segments})

    @contextlib.contextmanager
    def transaction(self):
        """All that is written inside becomes visible at once, at its end, or not at all; reads
        inside see it before. One in another belongs to the outer one."""
        if self._open is not None:
            yield self
            return
        before = self._manifest()
        self._open = before
        try:
            yield self
            _, tables = self._open
        finally:
            self._open = None
        if tables != before[1]:
            self._commit(before[0] + 1, tables)

    def vacuum(self, name: str) -> int:
        """Removes folders and manifests that the current manifest has made obsolete."""
        number, segments = self.state(name)
        path, system = self._path(name)
        if not system.exists(path):
            return 0
        named = {s.folder.rsplit("/", 1)[1] for s in segments}
        lost = [f.getPath() for f in system.listStatus(path) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in named]
        manifests = self._path("_manifests")[0]
        if system.exists(manifests):
            lost += [f.getPath() for f in system.listStatus(manifests) if int(f.getPath().getName()) < number]
        for p in lost:
            system.delete(p, True)
        return len(lost)

    # -- writing ----------------------------------------------------------------------

    @staticmethod
    def hashed(name: str, columns: tuple[str, ...] = ()) -> Column:
        """The stored bits of a row's hash, by the table's key or columns with its values."""
        return F.xxhash64(*(columns or LAYOUTS[name].key)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def _segment(self, name: str, rows: DataFrame, number: int, tier: int | None = None, size: int | None = None, living: bool = False) -> Segment:
        """Writes rows with ``_dead``; what turns out larger than a part is dealt anew by its size. How a table
        that is spread is dealt depends on its rows, which are put down first as they come."""
        rows = rows.select(*TABLES[name].fieldNames(), "_dead", self.hashed(name).alias("_h"), *(c for c in ("_number",) if c in rows.columns))
        spread = LAYOUTS[name].spread
        parts = 0 if spread else self._parts(name, size or 0)
        folder = self._written(name, rows, parts, living)
        found = self._size(folder)
        if self._parts(name, found) > 2 * parts:
            raw, parts = folder, self._parts(name, found)
            rows = self._dealer().read.schema(rows.drop("_number").schema).parquet(raw)
            hot = self._hot(name, rows, parts) if spread and parts > 1 else None
            if hot is not None:
                key = list(LAYOUTS[name].key)
                marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")  # fewer rows than parts
                rows = marked.withColumn("_h", F.when(F.col("_hot"), self.hashed(name, (*key, spread))).otherwise(F.col("_h"))).drop("_hot").select(*rows.columns)
            folder = self._written(name, rows, parts)
            found = self._size(folder)
            if hot is not None:
                hot.write.parquet(f"{folder}/_hot")
            path, system = self._path(name, raw.rsplit("/", 1)[1])
            system.delete(path, True)
        by_size = 0
        while found >= SMALL_BYTES * self.fan ** (by_size + 1):
            by_size += 1
        return Segment(folder, number, parts, found, max(by_size, tier or 0))

    def _dealer(self) -> SparkSession:
        """A session that reads RAW_BYTES a task: one that deals rows to many parts holds all that it has read."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(RAW_BYTES))
        return session

    def _hot(self, name: str, rows: DataFrame, parts: int) -> DataFrame | None:
        """Keys with more than a part's share of the rows, which are fewer than parts; None if there is none."""
        key = list(LAYOUTS[name].key)
        share = rows.count() / parts
        counted = rows.groupBy(*key).count().where(F.col("count") > share).select(*key)
        found = counted.collect()
        return rows.sparkSession.createDataFrame(found, counted.schema) if found else None

    def _parts(self, name: str, size: int) -> int:
        parts = 1
        while parts * self.part_bytes < size * LAYOUTS[name].packed and parts < 1 << BITS:
            parts *= 2
        return parts

    def _written(self, name: str, rows: DataFrame, parts: int, living: bool = False) -> str:
        """Each part is dealt to a task of its own. Of rows with ``_number`` the newest of each unit are
        kept, found where their part is written, so that a merge shuffles a row once. ``living``: without marks.
        Without ``parts`` rows are neither dealt nor sorted."""
        folder = f"{self.root}/{name}/v-{uuid.uuid4().hex}"
        if not parts:
            (rows.where("not _dead") if living else rows).write.option("compression", CODEC).option("parquet.block.size", RAW_BYTES).parquet(folder)
            return folder
        part = rows.withColumn("part", F.col("_h").bitwiseAND(F.lit(parts - 1)))
        if parts > 1 and LAYOUTS[name].spread:
            part = part.mapInArrow(_blocks, "part int, block binary").repartitionById(parts, F.col("part")).select("block").mapInArrow(_of_blocks, part.schema)
        elif parts > 1:
            part = part.repartitionById(parts, F.col("part"))
        if "_number" in part.columns:
            part = self._newest(part, LAYOUTS[name], [c for c in part.columns if c != "_number"], ("part", "_h"))
        if living:
            part = part.where("not _dead")
        part.sortWithinPartitions("part", "_h", *LAYOUTS[name].unit).write.option("compression", CODEC).partitionBy("part").parquet(folder)
        return folder

    def put(self, name: str, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """Adds a segment: ``rows`` replace their units, or meet them by the highest; units of
        ``removed`` (the unit's columns) that rows don't bring have no rows any more."""
        self.add(name, rows, removed)
        self.tidy(name)

    def add(self, name: str, rows: DataFrame, removed: DataFrame | None = None, replaced: DataFrame | None = None) -> DataFrame:
        """As :meth:`put`, but merges nothing yet; the segment's rows with ``_dead``, true for marks. ``replaced`` are
        rows of the table all of whose units go, those that ``rows`` bring again too: they are the marks, as they are, so
        nothing is compared. A mark counts against older segments, not against rows of its own."""
        unit = list(LAYOUTS[name].unit)
        number, segments = self.state(name)
        marked = self._marked(name, rows)
        if removed is not None:
            gone = removed.select(*unit).distinct().join(rows.select(*unit).distinct(), unit, "left_anti").withColumn("_dead", F.lit(True))
            marked = marked.unionByName(gone, allowMissingColumns=True).select(*marked.columns)
        if replaced is not None:
            marked = marked.unionByName(replaced.withColumn("_dead", F.lit(True)).select(*marked.columns))
        newest = max([number, *(s.number for s in segments)]) + 1  # several in a transaction stay in order
        segment = self._segment(name, marked, newest)
        self._replace(name, [*segments, segment])
        rows = self._rows(name, segment, None)
        return self.spark.createDataFrame([], marked.schema) if rows is None else rows.select(*marked.columns)

    def tidy(self, name: str) -> None:
        """Merges segments where there are enough of a size."""
        _, segments = self.state(name)
        merged = self._merged(name, segments)
        if merged != segments:
            self._replace(name, merged)

    def write(self, name: str, state: DataFrame) -> None:
        """Makes ``state`` what the table holds."""
        number, segments = self.state(name)
        newest = max([number, *(s.number for s in segments)]) + 1
        self._replace(name, [self._segment(name, self._marked(name, state), newest)])

    @staticmethod
    def _marked(name: str, rows: DataFrame) -> DataFrame:
        layout, columns = LAYOUTS[name], TABLES[name].fieldNames()
        if layout.merged is not None:
            rows = rows.groupBy(*layout.unit).agg(layout.merged)
        return rows.select(*columns, F.lit(False).alias("_dead"))

    def _merged(self, name: str, segments: list[Segment]) -> list[Segment]:
        """Merges the newest segments where ``fan`` of them are of a size or smaller."""
        for tier in sorted({s.tier for s in segments}):
            run = 0
            while run < len(segments) and segments[-1 - run].tier <= tier:
                run += 1
            if run >= self.fan:
                older, newest = segments[:-run], segments[-run:]
                one = self._segment(name, self._together(name, newest), newest[-1].number, tier + 1, sum(s.bytes for s in newest), not older)
                return self._merged(name, [*older, one])
        return segments

    def _together(self, name: str, segments: list[Segment]) -> DataFrame:
        """Rows of segments that become one. Those of a table whose later rows replace others keep their
        number, by which :meth:`_written` finds the newest; what is summed or spread is settled here."""
        layout = LAYOUTS[name]
        rows = None if layout.merged is not None or layout.spread else self._union(name, segments, None)
        return self._latest(name, segments, None) if rows is None else rows

    def compact(self, name: str) -> None:
        """Makes one segment of all, without marks of what was removed."""
        number, segments = self.state(name)
        if len(segments) > 1:
            one = self._segment(name, self._together(name, segments), segments[-1].number, max(s.tier for s in segments), sum(s.bytes for s in segments), True)
            self._replace(name, [one])

    # -- reading ----------------------------------------------------------------------

    def touched(self, name: str, keys: DataFrame, *columns: str) -> list[int]:
        """The stored hashes of keys (of a batch, or of a frontier), each once."""
        return sorted(r.h for r in keys.select(self.hashed(name, columns).alias("h")).distinct().collect())

    def read(self, name: str, hashes: list[int] | None = None) -> DataFrame:
        """The table, or the rows with some hashes, which are those of the keys that were asked
        for and a few more."""
        _, segments = self.state(name)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        return self._latest(name, segments, hashes).where("not _dead").select(*TABLES[name].fieldNames())

    def of_keys(self, name: str, keys: list[str]) -> DataFrame:
        """The rows of some values of a table's one key column: their parts, and of a segment in
        which one of them is spread, all parts, each sorted by the key."""
        _, segments = self.state(name)
        [key] = LAYOUTS[name].key
        one = self.spark.sql("select 1").select(F.array_distinct(F.transform(F.array(*map(F.lit, keys)), lambda k: F.xxhash64(k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))))
        hashes = sorted(one.first()[0])
        spread = set()
        for s in segments:
            path, system = self._path(name, s.folder.rsplit("/", 1)[1], "_hot")
            if LAYOUTS[name].spread and system.exists(path) and not self.spark.read.parquet(f"{s.folder}/_hot").where(F.col(key).isin(keys)).isEmpty():
                spread.add(s.folder)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        rows = self._latest(name, segments, hashes, spread, F.col(key).isin(keys))
        return rows.where("not _dead").select(*TABLES[name].fieldNames())

    def _rows(self, name: str, segment: Segment, hashes: list[int] | None) -> DataFrame | None:
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in TABLES[name].fields)}, _dead boolean, _h int"
        path, system = self._path(name, segment.folder.rsplit("/", 1)[1])
        there = {f.getPath().getName() for f in system.listStatus(path)}
        wanted = there if hashes is None else {f"part={h & (segment.parts - 1)}" for h in hashes}
        paths = sorted(f"{segment.folder}/{p}" for p in wanted & there if p.startswith("part="))
        if not paths:
            return None
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows if hashes is None or not 0 < len(hashes) <= TESTED else rows.where(f"_h in ({', '.join(map(str, hashes))})")

    def _union(self, name: str, segments: list[Segment], hashes: list[int] | None, whole=frozenset(), test=None) -> DataFrame | None:
        out = None
        for s in segments:
            rows = self._rows(name, s, None if s.folder in whole else hashes)
            if rows is not None:
                rows = rows if test is None else rows.where(test)
                rows = rows.withColumn("_number", F.lit(s.number))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _latest(self, name: str, segments: list[Segment], hashes: list[int] | None, whole=frozenset(), test: Column | None = None) -> DataFrame:
        """The rows that count, with marks of removed units. The oldest segment, which holds most,
        isn't shuffled by unit with the rest: what the rest doesn't touch is its own."""
        layout, columns = LAYOUTS[name], [*TABLES[name].fieldNames(), "_dead"]
        unit = list(layout.unit)
        base, rest = self._union(name, segments[:1], hashes, whole, test), self._union(name, segments[1:], hashes, whole, test)
        if rest is None or base is None:
            only = base if rest is None else rest
            if only is None:
                return self.spark.createDataFrame([], TABLES[name]).withColumn("_dead", F.lit(False))
            return self._newest(only, layout, columns) if only is rest else only.select(*columns)
        changed = rest.select(*unit).distinct()
        kept = base.join(changed, unit, "left_anti")
        if layout.merged is not None:
            rest = rest.unionByName(base.join(changed, unit, "left_semi"))
        return kept.select(*columns).unionByName(self._newest(rest, layout, columns))

    @staticmethod
    def _newest(rows: DataFrame, layout: Layout, columns: list[str], dealt: tuple[str, ...] = ()) -> DataFrame:
        """``dealt``: columns that follow from the unit, by which rows lie already."""
        unit = list(layout.unit)
        if layout.merged is not None:
            return rows.groupBy(*unit).agg(layout.merged, F.min("_dead").alias("_dead")).select(*columns)
        newest = F.max("_number").over(Window.partitionBy(*dealt, *unit))
        return rows.withColumn("_newest", newest).where("_number = _newest").select(*columns)

    def wipe_chunks(self) -> None:
        """Drops the chunk layer; documents, edges, cursors and meta stay."""
        self.write("chunks", self.spark.createDataFrame([], TABLES["chunks"]))


class Lease:
    """One writer at a time, over files. The holder of the newest numbered file holds the lease;
    the next number may be created, which one of several succeeds in, once that file has been
    released or not been renewed for ``ttl`` seconds. A file counts as renewed when it was made,
    by the file system's own time, until its holder's first beat. ``clock`` gives seconds."""

    def __init__(self, spark: SparkSession, root: str, holder: str, ttl: float = 60.0, clock=time.time):
        self.spark, self.root, self.holder, self.ttl, self.clock = spark, f"{root.rstrip('/')}/_lease", holder, ttl, clock
        self.number: int | None = None
        self.lost = False

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> dict[str, float]:
        """File names with the seconds since each was made."""
        path, system = self._file("")
        if not system.exists(path):
            return {}
        return {f.getPath().getName(): time.time() - f.getModificationTime() / 1000 for f in system.listStatus(path)}

    def _newest(self) -> tuple[int, bool, float]:
        """The newest number, whether it was released, and the seconds since it was renewed."""
        names = self._listed()
        number = max((int(n.split(".")[0]) for n in names), default=0)
        beats = [float(n.split(".", 2)[2]) for n in names if n.startswith(f"{number}.beat.")]
        age = self.clock() - max(beats) if beats else names.get(f"{number}.held", 0.0)
        return number, f"{number}.released" in names or not number, age

    def _create(self, name: str) -> bool:
        path, system = self._file(name)
        try:
            system.create(path, False).close()
        except Exception:  # noqa: BLE001  the file system's own exception: somebody else was first
            return False
        return True

    def _tidy(self) -> None:
        """Removes the files of numbers that are over, and this number's beats but the newest."""
        names = self._listed()
        beats = sorted((n for n in names if n.startswith(f"{self.number}.beat.")), key=lambda n: float(n.split(".", 2)[2]))
        for name in [n for n in names if int(n.split(".")[0]) < (self.number or 0)] + beats[:-1]:
            path, system = self._file(name)
            system.delete(path, False)

    def acquire(self) -> bool:
        number, released, age = self._newest()
        if not released and number != self.number and age <= self.ttl:
            return False
        if not released and number == self.number:
            return self.heartbeat()
        if not self._create(f"{number + 1}.held"):
            return False
        self.number, self.lost = number + 1, False
        self._create(f"{self.number}.beat.{self.clock():.3f}")
        self._tidy()
        return True

    def heartbeat(self) -> bool:
        """Renews the lease; False if it has been lost."""
        number, released, _ = self._newest()
        if self.number is None or number != self.number or released:
            self.lost = True
            return False
        self._create(f"{number}.beat.{self.clock():.3f}")
        self._tidy()
        return True

    @contextlib.contextmanager
    def kept(self, every: float | None = None):
        """Renews the lease from a thread of its own while the block runs, a quarter of ``ttl``
        apart; once it is lost ``lost`` is set and stays."""
        stop = threading.Event()

        def beat():
            while not stop.wait(every or self.ttl / 4):
                try:
                    if not self.heartbeat():
                        return
                except Exception:  # noqa: BLE001  a beat that fails is tried again; the time to live decides
                    continue

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            stop.set()
            thread.join()

    def release(self) -> None:
        if self.number is not None:
            self._create(f"{self.number}.released")
            self.number = None
