"""Personal data by anchors and local parsers."""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds in the order that settles ties of starts; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
#: Identifier cues, lower case, before a value (fixed values).
CUES = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth_key",
    "iban", "account", "acct", "ssn", "passport", "routing", "customer id", "user id", "license no",
)
#: Cues whose value is an account number rather than a secret.
ACCOUNT_CUES = frozenset(CUES[10:])
#: Starts of keys that say by themselves what they are, and the length that follows (fixed values).
KEY_STARTS = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "sk-": 20, "xoxb-": 20, "AIza": 35}
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
_VALUE = re.compile(r"""["']?\s*(?:(?:=|:|is|no\.?|number|#)\s*)+["']?([A-Za-z0-9_+/.-]{6,})""")
_KEY = re.compile(r"[A-Za-z0-9_-]+")


@functools.lru_cache(maxsize=1)
def _automaton():
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", *_DIGITS, *KEY_STARTS, *SCHEMES):
        found.add_word(anchor, anchor)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` in code points, by start and then kind.

    One pass of the automaton gives anchors in order of their ends. Of each kind, what a
    parser has matched is consumed whether or not it passes validation, as a leftmost
    non-overlapping search would; so an anchor inside it starts nothing of that kind.
    """
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "digits"), 0)
    for end, a in _automaton().iter(text):
        at = end + 1 - len(a)
        if a in _DIGITS:
            if at < done["digits"]:
                continue
            run_end = _RUN.match(text, at).end()
            done["digits"] = run_end
            if at >= done["ip"] and (m := _QUAD.match(text, at)):
                done["ip"] = m.end()
                if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.groups()):
                    out.append(("ip", at, m.end()))
            if at >= done["card"] and (m := _CHAIN.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
        elif a == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif a == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append(("email", start, m.end()))
        elif a in KEY_STARTS:
            whole = at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")
            if whole and at >= done["secret"] and (m := _KEY.match(text, end + 1)):
                if len(m[0]) >= KEY_STARTS[a]:  # a run that is too short is short, so reading it again costs little
                    done["secret"] = m.end()
                    out.append(("secret", at, m.end()))
        elif a in SCHEMES:
            if at >= done["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?')]"))
                done["url"] = m.end()
                if stop > end + 1:
                    out.append(("url", at, stop))
    out += _cued(text, [s[1:] for s in out if s[0] == "secret"])
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@functools.lru_cache(maxsize=1)
def _cue_automaton():
    found = ahocorasick.Automaton()
    for cue in CUES:
        found.add_word(cue, cue)
    found.make_automaton()
    return found


def _cued(text: str, keys: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Values after a cue; those that are in one of ``keys`` are known already. A cue inside a
    run that was looked at for its kind starts nothing, so no run is read twice."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a few characters lower to two: they stay, so that places hold
        lowered = "".join([x if len(x := c.lower()) == 1 else c for c in text])
    out, over, keys, k = [], {"secret": 0, "account": 0}, sorted(keys), 0
    for end, cue in _cue_automaton().iter(lowered):
        at = end + 1 - len(cue)
        kind = "account" if cue in ACCOUNT_CUES else "secret"
        if end < over[kind] or at and lowered[at - 1].isalpha():
            continue
        m = _VALUE.match(text, end + 1)
        if not m or m.start(1) < over[kind]:
            continue
        value = m[1].rstrip(".-/")
        start, stop = m.start(1), m.start(1) + len(value)
        over[kind] = stop
        if len(value) >= 6 and any(c in _DIGITS for c in value):
            while k < len(keys) and keys[k][1] <= start:
                k += 1
            if kind == "account" or k == len(keys) or keys[k][0] >= stop:
                out.append((kind, start, stop))
    return out


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    A null or empty text has no spans: counts 0, the digest of no bytes, an empty string.
    Rows are independent, so repeated ids and empty tables need nothing, and a null id is
    returned as it is; only the two named columns are read, whatever else the table has.
    Work and memory are linear in the text: no run of characters is read by a parser again
    once it has been consumed, so texts of many megabytes without a space are no trouble.
    """

    def run(batches):
        for batch in slices(batches):
            found = [spans(t) if t else [] for t in batch.column("text").to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in BASE]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digests, pa.array([joined(f) for f in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return source.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """``text`` with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at, upto = [], 0, 0
    for kind, start, end in spans(text):
        if start >= upto:
            out.append(text[max(at, upto) : start])
            out.append(f"<{kind.upper()}>")
        upto = max(upto, end)
        at = upto
    out.append(text[upto:])
    return "".join(out)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced; a count of
    characters in ``length_col`` is brought up to date where the text changed. Null and empty
    texts stay as they are; repeated rows are treated alike; other columns, whatever they are
    called, pass through; an empty table gives an empty one."""
    fields = docs.columns
    text_at = fields.index(text_col)
    length_at = fields.index(length_col) if length_col in fields else None

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            new = [t and redacted(t) for t in texts]
            columns = batch.columns
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if length_at is not None:
                old = columns[length_at].to_pylist()
                columns[length_at] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new)], batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
