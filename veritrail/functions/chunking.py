"""Splitting of documents into chunks, by bytes.

A body becomes a table of blocks first: paragraphs and headings with their sizes and the
headings above them. Everything after that is arithmetic over the table: where chunks begin,
what they open with, and what they repeat of the chunk before. A body is handled in its own
row of an Arrow batch; sizes are prefix sums, so a body costs time linear in its length.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHUNK, CHUNK_MAX_BYTES, CHUNK_MIN_BYTES, CHUNK_OVERLAP_BYTES
from . import text as X

WHOLE = {"commit"}
COMMENTS = {"review_comment", "issue_comment", "ticket_comment"}
GAP = "\n\n"
#: A fenced stretch up to its closing fence (or the end), as one match; its lines are never headings.
_FENCED = re.compile(r"^[ \t]*(?P<mark>`{3,}(?=[^`\n]*$)|~{3,})[^\n]*$(?:\n(?![ \t]*(?P=mark)(?:`|~)*[ \t]*$)[^\n]*)*(?:\n[ \t]*(?P=mark)(?:`|~)*[ \t]*$)?", re.M)
_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_HEADING = re.compile(r"\s*(#{1,6})[ \t](?=.*\S)")
_WORD_BREAKS = b" \t\n"
#: Documents whose bodies and chunks a task holds at a time.
ROWS = 128


class Block(NamedTuple):
    """A paragraph (level 0) or heading."""

    text: str
    level: int = 0

    @property
    def size(self) -> int:
        return len(self.text.encode())


def blocks(body: str) -> list[Block]:
    """The blocks of a body in order: lines are classed one by one (a line inside a fence is
    plain, whatever it looks like; a blank one separates), and runs of a class are blocks."""
    fenced = [m.span() for m in _FENCED.finditer(body)]
    table: list[tuple[list[str], int]] = []
    open_, at_fence = False, 0
    for m in _LINE.finditer(body):
        line = m[0].rstrip("\n")
        while at_fence < len(fenced) and fenced[at_fence][1] <= m.start():
            at_fence += 1
        inside = at_fence < len(fenced) and fenced[at_fence][0] <= m.start()
        heading = None if inside else _HEADING.match(line)
        if not line.strip():
            open_ = False
        elif heading:
            table.append(([line.strip()], len(heading[1])))
            open_ = False
        elif open_:
            table[-1][0].append(line)
        else:
            table.append(([line], 0))
            open_ = True
    return [Block("\n".join(lines), level) for lines, level in table]


def headings_above(table: list[Block]) -> list[tuple[str, ...]]:
    """The headings above each block: at any place, the last heading of each level that no
    heading of the same or an outer level has followed."""
    last: dict[int, str] = {}
    above = []
    for block in table:
        if block.level:
            last = {level: text for level, text in last.items() if level < block.level}
        above.append(tuple(last[level] for level in sorted(last)))
        if block.level:
            last[block.level] = block.text
    return above


def _past_space(raw: bytes, at: int) -> int:
    """The first place from ``at`` on that isn't white space, looked for a stretch at a time."""
    while at < len(raw):
        end = min(at + 64, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        left = raw[at:end].decode().lstrip()
        if left:
            return end - len(left.encode())
        at = end
    return at


def pieces(text: str, most: int) -> list[str]:
    """``text`` in parts of at most ``most`` bytes, cut at the last word break that fits, or else
    before the character that doesn't; spaces at cuts are dropped."""
    raw, parts, at = text.encode(), [], 0
    while len(raw) - at > most:
        cut = max(raw.rfind(bytes([b]), at, at + most) for b in _WORD_BREAKS)
        if cut <= at:
            cut = at + most
            while cut > at + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
        parts.append(raw[at:cut].decode().strip())
        at = _past_space(raw, cut)
    parts.append(raw[at:].decode().strip())
    return [p for p in parts if p] or [text]


def tail(text: str, size: int) -> str:
    """About the last ``size`` bytes of a text, from the first word break or character in them."""
    raw = text.encode()
    if len(raw) <= size:
        return text
    end = raw[-size:]
    breaks = [i for i in (end.find(bytes([b])) for b in _WORD_BREAKS) if i >= 0]
    return end[min(breaks) + 1 if breaks else 0 :].decode(errors="ignore").strip()


def boundaries(table: list[Block], least: int, most: int) -> list[tuple[int, int]]:
    """Ranges of blocks that make a chunk. A chunk begins where the blocks since its beginning
    and the gaps between them would pass ``most`` bytes with the next one, or at a heading once
    they have ``least``. Of a block beyond ``most``, only what is left after its parts of full
    size counts for what follows."""
    ranges, first, size = [], 0, 0
    for i, block in enumerate(table):
        n = block.size
        if size and (size + len(GAP) + n > most or block.level and size >= least):
            ranges.append((first, i))
            first, size = i, 0
        if n > most:
            n = len(pieces(block.text, most)[-1].encode())
        size += n + (len(GAP) if size else 0)
    return [*ranges, (first, len(table))] if table else []


def split(body: str, least: int = CHUNK_MIN_BYTES, most: int = CHUNK_MAX_BYTES, shared: int = CHUNK_OVERLAP_BYTES) -> list[str]:
    """The chunks of a body: the parts of each range's blocks, opened by the headings above the
    range and by the end of the chunk before, without its headings."""
    table, bare = blocks(body), []
    opened = headings_above(table)
    for first, last in boundaries(table, least, most):
        above = opened[first]
        held: list[str] = []
        for block in table[first:last]:
            *whole, text = pieces(block.text, most) if block.size > most else [block.text]
            bare += [(above, part) for part in whole]
            held.append(text)
        bare.append((above, GAP.join(held)))
    out, before = [], ""
    for above, text in bare:
        before = tail(before, shared) + GAP + text if before else text
        out.append("\n".join(above) + GAP + before if above else before)
    return out


def chunk_texts(kind: str | None, body: str | None) -> list[str]:
    body = (body or "").strip()
    if not body:
        return []
    return [body] if kind in WHOLE | COMMENTS else split(body)


def chunk(documents: DataFrame) -> DataFrame:
    """Chunks of documents with the documents' attributes on them; a blank body has none, a
    commit or comment is one, and a comment's chunk names its thread. Cutting by bytes at word
    breaks is beyond the built-in functions, so this is one Arrow-batched pass."""
    schema = CHUNK.__class__([f for f in CHUNK.fields if f.name != "embedding"])
    kept = ["doc_id", "source", "repo_ref", "doc_type", "author", "created_at", "updated_at"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [chunk_texts(k, b) for k, b in zip(some.column("doc_type").to_pylist(), some.column("body").to_pylist())]
                of = pa.array([i for i, t in enumerate(texts) for _ in t], pa.int32())
                made = {c: some.column(c).take(of) for c in kept}  # times stay what they are, whatever their year
                made["ordinal"] = pa.array([i for t in texts for i in range(len(t))], pa.int32())
                made["text"] = pa.array([x for t in texts for x in t], pa.string())
                made["thread_id"] = some.column("thread_id").take(of)
                yield pa.RecordBatch.from_arrays([made[f.name] for f in schema.fields], names=schema.fieldNames())

    thread = F.when(F.col("doc_type").isin(*COMMENTS), X.thread_id(F.col("doc_id"))).otherwise(F.lit(""))
    rows = documents.withColumnRenamed("type", "doc_type").select(*kept, thread.alias("thread_id"), "body")
    return rows.mapInArrow(run, schema).withColumn("embedding", F.lit(None).cast("array<float>"))
