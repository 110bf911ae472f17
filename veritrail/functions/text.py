"""Column functions over ids, references and text; all native expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKET = r"[A-Z][A-Z0-9]+-\d+"
URL = r"https?://[^\s<>()\[\]{}\"'`]+"
SHA = r"\b[0-9a-f]{7,40}\b"
# Runs end where no backtracking could help and are possessive, and one begins after what isn't of its kind or
# where a match ended, since within a run all places fail alike. So a long run is scanned once.
PATH = r"(?:(?<![\w.-])|\G)[\w.-]++(?:/[\w.-]+)+\.[A-Za-z][A-Za-z0-9]*"
_BEGINS, _NAME = r"(?:(?<![A-Za-z0-9])|\G)", r"[A-Za-z0-9][A-Za-z0-9._-]*+"
NUMBER = rf"(?:{_BEGINS}{_NAME}/{_NAME})?#\d+"
MERGE_NUMBER = rf"(?:{_BEGINS}(?:{_NAME}/)++{_NAME})?[#!]\d+"
TOKEN = r"[\p{L}\p{N}]+"
COMPOUND = r"[\p{L}\p{N}]+(?:[._\-/][\p{L}\p{N}]+)*"


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, also where ``body`` uses it inside a
    lambda, which is evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics, as the index compares words."""
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def doc_id(source: Column, kind: Column, external: Column) -> Column:
    return F.concat_ws(":", source, kind, external)


def external_id(doc: Column) -> Column:
    """What follows the second colon; empty if there are fewer."""
    return F.regexp_extract(doc, r"(?s)^[^:]*:[^:]*:(.*)$", 1)


def sha_prefix(doc: Column, kind: Column) -> Column:
    """The first 12 digits of a commit's hash, lower case; empty for anything else."""
    key = F.substring_index(external_id(doc), "/", -1)
    return F.when((kind == "commit") & key.rlike("^[0-9a-fA-F]{7,}$"), F.lower(F.substring(key, 1, 12))).otherwise(F.lit(""))


def thread_id(doc: Column) -> Column:
    """The id up to its last ``#``, unless that is its first character; else the id."""
    head = F.regexp_extract(doc, r"(?s)^(.+)#[^#]*$", 1)
    return F.when(head != "", head).otherwise(doc)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def ticket_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TICKET), F.lit(0))


def urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:!?")))


def commit_shas(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SHA), F.lit(0))


def file_paths(text: Column) -> Column:
    """Paths outside URLs, which are masked by a space first."""
    return F.regexp_extract_all(F.regexp_replace(text, URL, " "), F.lit(PATH), F.lit(0))


def _numbered(found: Column, repository: Column) -> Column:
    return F.transform(found, lambda m: F.concat(F.coalesce(F.nullif(F.substring_index(m, "#", 1), F.lit("")), repository), F.lit("#"), F.substring_index(m, "#", -1)))


def numbers(text: Column, repository: Column) -> Column:
    """``owner/name#n`` for each ``#n``; one without a repository takes the document's."""
    return _numbered(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), repository)


def merge_numbers(text: Column, repository: Column) -> Column:
    """The same for ``#n`` and ``!n`` with nested names."""
    found = F.regexp_extract_all(text, F.lit(MERGE_NUMBER), F.lit(0))
    return _numbered(F.transform(found, lambda m: F.translate(m, "!", "#")), repository)


def refs(text: Column, repository: Column) -> Column:
    """All references of a text in scanner order, with repeats: an array of (kind, value, instance)."""

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("").alias("instance")))

    body = F.coalesce(text, F.lit(""))
    return F.concat(
        of("ticket_key", ticket_keys(body)), of("url", urls(body)), of("commit_sha", commit_shas(body)),
        of("file_path", file_paths(body)), of("pr_number", numbers(body, repository)),
    )


def ref_set(found: Column) -> Column:
    """First-seen order without repeats; a reference without an instance gives way to one of
    the same kind and value that has one, wherever that stands."""
    key = lambda r: F.struct(r["kind"].alias("kind"), r["value"].alias("value"))

    def unscoped_last(distinct: Column) -> Column:
        scoped = F.transform(F.filter(distinct, lambda r: r["instance"] != ""), key)
        return let(scoped, lambda some: F.filter(distinct, lambda r: (r["instance"] != "") | ~F.array_contains(some, key(r))))

    return let(F.array_distinct(found), unscoped_last)


def without_self(found: Column, key: Column) -> Column:
    """Without a ticket's own key."""
    return F.filter(found, lambda r: ~((r["kind"] == "ticket_key") & (r["value"] == key)))


def scoped_ref(kind: str, value: Column, instance: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), instance.alias("instance"))


def page_key(url: Column) -> Column:
    """The dashed page id at the end of a wiki page's address; null for other addresses."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    known = host.isin("notion.so", "www.notion.so", "app.notion.com") | host.endswith(".notion.site")
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    last = F.regexp_replace(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1), "-", "")
    return F.when(known, dashed(F.regexp_extract(F.lower(last), r"([0-9a-f]{32})$", 1)))


def dashed(key: Column) -> Column:
    return F.when(key.rlike("^[0-9a-f]{32}$"), F.regexp_replace(key, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"))


def page_id(text: Column) -> Column:
    """Lower case without dashes; null if it isn't 32 hex digits."""
    plain = F.lower(F.replace(trimmed(text), F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def byte_excerpt(text: Column, limit: int = 500) -> Column:
    """The first ``limit`` bytes, less what would split a character: continuation bytes that
    the cut leaves at the end go with their incomplete lead byte."""
    raw = F.encode(text, "UTF-8")
    hexed = F.hex(F.substring(raw, 1, limit))
    partial = "(?:[C-F][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-7][89AB][0-9A-F]|F[0-7][89AB][0-9A-F][89AB][0-9A-F])$"
    whole = F.regexp_replace(hexed, f"^((?:[0-9A-F]{{2}})*?){partial}", "$1")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def capped(text: Column, limit: int = 8000, hint: str = "") -> Column:
    """The first ``limit`` characters and, if there are more, a note of how many there were."""
    total = F.length(text)
    note = F.concat(F.lit("\n\n[truncated: "), F.format_number(F.lit(limit), 0), F.lit(" of "), F.format_number(total, 0), F.lit(" characters shown."), F.lit(hint), F.lit("]"))
    return F.when(total <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), note))


def event_date(text: Column) -> Column:
    """A date, or a date and time with zone, as a timestamp; null for anything else."""
    t = F.trim(text)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    return day.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), t.try_cast("timestamp"))


def window_bound(text: Column, upper: bool) -> Column:
    """A day stands for its first second as a lower and its last as an upper bound."""
    day = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$")
    at = event_date(text)
    return F.when(day & F.lit(upper), at + F.expr("interval 86399 seconds")).otherwise(at)


def ticket_time(text: Column) -> Column:
    """Time with milliseconds and an offset without a colon."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXX"))


def both_times(created: Column, updated: Column) -> list[Column]:
    """A missing time is taken from the other; both in whole seconds."""
    return [F.date_trunc("SECOND", F.coalesce(a, b)).alias(n) for a, b, n in ((created, updated, "created_at"), (updated, created, "updated_at"))]


#: Role of a document that a walk reaches, by type (fixed values); other types are linked changes.
ROLES = {
    "page": "design_doc", "issue": "linked_ticket", "ticket": "linked_ticket", "pr_review": "review_thread", "review_comment": "review_thread",
    "issue_comment": "review_thread", "ticket_comment": "review_thread", "pr": "linked_change", "commit": "linked_change",
}


def role(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit("linked_change"))


def supersedes(text: Column, written: Column) -> Column:
    """Whether one line has both the written reference, not inside a longer word, and a
    phrase of replacement."""
    bounded = F.concat(F.lit(r"(?<![0-9a-z])\Q"), F.lower(written), F.lit(r"\E(?![0-9a-z])"))
    lines = F.split(F.lower(text), "\n")
    return F.exists(lines, lambda x: x.rlike("supersede|replaces|replaced by") & F.regexp_like(x, bounded))


def cites(answer: Column, n: Column) -> Column:
    """Whether an answer cites only sources 1 to n, and at least one if there are any."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[\s*(\d{1,9})\s*\](?!\()"), F.lit(1)), lambda x: x.cast("int"))
    return F.forall(marks, lambda x: (x >= 1) & (x <= n)) & ((n == 0) | (F.size(marks) > 0))
