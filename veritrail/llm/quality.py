"""Quality rules as a ledger of failure bits, with versioned policies and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules by bit: name and the condition of failing, over the measurements of :func:`measured`.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 14 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("ellipses", "10 * n_ellipses > n_words"),
    ("many_words", "n_words > 1000000"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("duplicate_line_majority", "100 * n_dup_lines > 60 * n_lines"),
]
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that drop a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "upper_case", "exclamations"),
    "v3": (*BASE, "symbols", "upper_case", "exclamations", "duplicate_line_majority", "long_words", "short_words", "ellipses", "digits"),
}
CURRENT = "v3"


def mask(names) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows are sorted by hash within the
    row; neighbours of equal hash are compared word by word; then the places covered by
    the windows found are counted, overlaps once."""
    windows = F.size(words) - 2
    triples = F.arrays_zip(F.slice(words, 1, windows), F.slice(words, 2, windows), F.slice(words, 3, windows))
    hashes = F.transform(triples, lambda z: F.xxhash64(z))

    def among(h: Column) -> Column:
        keyed = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        return let(keyed, covered)

    def covered(s: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            y = F.get(s, k)
            alike = [F.get(words, x["i"] + n) == F.get(words, y["i"] + n) for n in range(3)]
            return F.coalesce((y["h"] == x["h"]) & alike[0] & alike[1] & alike[2], F.lit(False))

        found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        places = F.sort_array(F.transform(found, lambda x: x["i"]))
        return let(places, lambda p: F.when(F.size(p) > 0, _union(p)).otherwise(F.lit(0)))

    def _union(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return F.when(windows < 2, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(among(h))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of each row, in one narrow pass of native expressions; a null text measures
    as an empty one, and columns other than the two named ones are ignored."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    trimmed = F.trim(F.col("_t"), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    size = F.length("_t")
    cut = text.select(
        "doc_id",
        "_t",
        let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("_l"),
    )
    long = lambda c: c.cast("bigint")
    return cut.select(
        "doc_id",
        long(F.col("_w.n_words")).alias("n_words"),
        long(F.length(_without(F.col("_t"), SPACES))).alias("word_chars"),
        long(size - F.length(_without(F.col("_t"), SYMBOLS))).alias("n_symbols"),
        long(F.col("_l.n_dup_lines")).alias("n_dup_lines"),
        long(F.col("_w.n_repeat_words")).alias("n_repeat_words"),
        long(F.col("_l.n_lines")).alias("n_lines"),
        long(F.length(F.regexp_replace("_t", "[^A-ZÀ-ÖØ-Þ]+", ""))).alias("n_upper"),
        long(size - F.length(_without(F.col("_t"), "!"))).alias("n_exclamations"),
        long((size - F.length(F.replace(F.col("_t"), F.lit("..."), F.lit("")))) / 3).alias("n_ellipses"),
        long(F.length(F.regexp_replace("_t", "[^0-9]+", ""))).alias("n_digits"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements, and ``failure_bits``: bit i is set if rule i fails. Each
    rule is evaluated once for a row; policies and ablations read the bits alone.

    A null text counts as empty: no words, no lines, so only ``few_words`` fails. Rows are
    independent, whatever repeats; an empty table gives an empty ledger. A long text is one row's
    work, in proportion to its words; only the two named columns are read.
    """
    found = measured(docs, id_col, text_col)
    bits = F.lit(0).cast("bigint")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return found.withColumn("failure_bits", bits)


def kept_by(version: str = CURRENT) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def judged(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The base measurements, ``base_failed`` and the verdict of a policy from the ledger's bits. Null
    texts fail for want of words; null ids, repeated rows, ties and empty tables need nothing, rows being
    independent; texts are read whole, whatever their length; other columns of ``docs`` are ignored."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"),
        kept_by(version).alias("kept"),
        "failure_bits",
    )


def ablations(found: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone of the policy's
    rules, and that the policy would keep without it. The ledger is reduced to counts by
    masked bits (at most two to the number of rules) before rules are looked at."""
    whole = mask(POLICIES[version])
    sums = found.groupBy(F.col("failure_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[version]))
    each = sums.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("r.bit"))) == 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(fails).alias("failing"), count(F.col("bits") == F.col("r.bit")).alias("failing_alone"), count(without).alias("kept_without")
    )
