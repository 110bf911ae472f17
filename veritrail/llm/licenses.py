"""License detections by ordered signature rules over normalised words."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Characters that aren't in words, as a regular expression; A-Z stand for a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base: label and words that stand consecutively (fixed values).
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Families: label, keyword that a text must hold, words of the name (fixed values). The
#: keyword is in all that the words match: names without a common one have a row for each.
FAMILIES = [
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version)? 2 0"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("mit", "mit", "mit(?: style)? licen[cs]e"),
    ("mit", "expat", "expat(?: style)? licen[cs]e"),
    ("mit", "x11", "x11(?: style)? licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e(?: version)? 2 1"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library", "(?:gnu )?library general public licen[cs]e"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e(?: version)? 3(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e(?: version)? 2(?: 0)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e(?: version)? 1(?: 0)?"),
    ("gpl-name", "gpl", "(?:gnu )?gpl(?: ?v ?[123]| [123])?"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version)? 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version)? 1 1"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? 2 0"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("cddl", "common development", "common development and distribution licen[cs]e"),
    ("cpl", "common public", "common public licen[cs]e"),
    ("eupl", "european union", "european union public licen[cs]e"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version)? 2 0"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", "boost software licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "want to public", "do what the fuck you want to public licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("python", "python", "python(?: software foundation)? licen[cs]e"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e"),
    ("odbl", "open database", "open database licen[cs]e"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "nc", "cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "nc", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "nc", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "nd", "cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "sa", "cc by sa(?: [1234] [05])?"),
    ("cc-by-4.0", "cc by", "cc by [1234] [05]"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-name", "commons", "creative commons attribution"),
]
#: What a family's name may stand in, the more telling first: words before it, and a second
#: keyword that a text must hold (fixed values).
CONTEXTS = [
    ("(?:is |are )?(?:dual )?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", "ed under "),
    ("(?:re)?distributed under (?:the )?(?:terms of (?:the )?)?", "distributed under "),
    ("(?:is )?released under (?:the )?(?:terms of (?:the )?)?", "released under "),
    ("(?:available|provided|published) under (?:the )?(?:terms of (?:the )?)?", " under "),
    ("", ""),
]
_ANY = "(?: only| or later)?"
#: SPDX short identifiers, which stand after "SPDX-License-Identifier": label, words (fixed values).
SPDX = [
    ("0bsd", "0bsd"),
    ("afl", "afl [123] [0-9]"),
    ("agpl-1.0", f"agpl 1 0{_ANY}"),
    ("agpl-3.0", f"agpl 3 0{_ANY}"),
    ("apache-1.0", "apache 1 0"),
    ("apache-1.1", "apache 1 1"),
    ("apache-2.0", "apache 2 0(?: with llvm exception)?"),
    ("artistic", "artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", "artistic 2 0"),
    ("blueoak", "blueoak 1 0 0"),
    ("boost", "bsl 1 0"),
    ("bsd-2-clause", "bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4-clause", "bsd 4 clause(?: uc)?"),
    ("busl", "busl 1 1"),
    ("cc-by-4.0", "cc by [1234] [05]"),
    ("cc-by-nc", "cc by nc [1234] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]"),
    ("cc-by-nd", "cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa [1234] [05]"),
    ("cc0", "cc0 1 0"),
    ("cddl", "cddl 1 [01]"),
    ("cecill", "cecill (?:1 [01]|2 [01]|b|c)"),
    ("cpl", "cpl 1 0"),
    ("curl", "curl"),
    ("ecl", "ecl [12] 0"),
    ("epl", "epl 1 0"),
    ("epl-2.0", "epl 2 0"),
    ("eupl", "eupl 1 [012]"),
    ("gfdl", f"gfdl 1 [123](?: no)?(?: invariants)?{_ANY}"),
    ("gpl-1.0", f"gpl 1 0{_ANY}"),
    ("gpl-2.0", f"gpl 2 0{_ANY}"),
    ("gpl-3.0", f"gpl 3 0{_ANY}"),
    ("hpnd", "hpnd"),
    ("isc", "isc"),
    ("lgpl-2.0", f"lgpl 2 0{_ANY}"),
    ("lgpl-2.1", f"lgpl 2 1{_ANY}"),
    ("lgpl-3.0", f"lgpl 3 0{_ANY}"),
    ("lppl", "lppl 1 [0123][ac]?"),
    ("mit", "mit"),
    ("mit-0", "mit 0"),
    ("mit", "x11"),
    ("mpl-1.0", "mpl 1 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0(?: no copyleft exception)?"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("mulanpsl", "mulanpsl [12] 0"),
    ("ncsa", "ncsa"),
    ("odbl", "odbl 1 0"),
    ("ofl", "ofl 1 [01]"),
    ("openssl", "openssl"),
    ("osl", "osl [123] [01]"),
    ("php", "php 3 01?"),
    ("postgresql", "postgresql"),
    ("python", "(?:psf|python) 2 0"),
    ("ruby", "ruby"),
    ("sspl", "sspl 1 0"),
    ("unlicense", "unlicense"),
    ("upl", "upl 1 0"),
    ("vim", "vim"),
    ("w3c", "w3c"),
    ("wtfpl", "wtfpl"),
    ("zlib", "zlib"),
    ("zpl", "zpl [12] [01]"),
]
#: Identifiers that are everyday words: in an expression they count as its first part only.
EVERYDAY = {"curl", "openssl", "postgresql", "ruby", "vim", "w3c"}
#: Usual abbreviations that tell a license by themselves: label, keyword, words (fixed values).
SHORT = [
    ("apache-2.0", "apache", "apache ?v? ?2 0"),
    ("apache-2.0", "asl", "asl ?v? ?2(?: 0)?"),
    ("agpl-3.0", "agpl", f"(?:gnu )?agpl ?v? ?3(?: 0)?{_ANY}"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("lgpl-3.0", "lgpl", f"(?:gnu )?lgpl ?v? ?3(?: 0)?{_ANY}"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl ?v? ?2 1{_ANY}"),
    ("lgpl-2.0", "lgpl", f"(?:gnu )?lgpl ?v? ?2(?: 0)?{_ANY}"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("gpl-3.0", "gpl", f"(?:gnu )?gpl ?v? ?3 0{_ANY}"),
    ("gpl-2.0", "gpl", f"(?:gnu )?gpl ?v? ?2 0{_ANY}"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("mpl-2.0", " mpl", "mpl ?v? ?2(?: 0)?"),
    ("mpl-1.1", " mpl", "mpl ?v? ?1 1"),
    ("epl-2.0", " epl", "epl ?v? ?2(?: 0)?"),
    ("epl", " epl", "epl ?v? ?1(?: 0)?"),
    ("cddl", " cddl", "cddl(?: 1 [01])?"),
    ("eupl", " eupl", "eupl(?: ?v? ?1 [012])?"),
    ("boost", " bsl", "bsl 1 0"),
    ("ofl", " ofl", "(?:sil )?ofl ?v? ?1 [01]"),
    ("odbl", " odbl", "odbl"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("0bsd", "0bsd", "0bsd"),
]
#: Names that tell a license only after "licensed under" and the like: label, keyword, words (fixed values).
UNDER = [
    ("mit", " mit", "mit"),
    ("mit", "x11", "x11"),
    ("mit", "expat", "expat"),
    ("isc", " isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("bsd", " bsd", "bsd"),
    ("apache-2.0", "apache", "apache ?v? ?2"),
    ("apache", "apache", "apache"),
    ("mpl", " mpl", "mpl"),
    ("epl", " epl", "epl"),
    ("ofl", " ofl", "(?:sil )?ofl"),
]
#: Sentences that stand by themselves: label, keyword, words (fixed values).
SENTENCES = [
    ("mit", "permission is", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither", "neither the name of [^ ]+(?: [^ ]+){0,6} nor the names of its contributors"),
    ("warranty", "warrant", "without warrant(?:y|ies) of any kind"),
    ("warranty", "as is", "(?:is )?provided as is"),
    ("gpl", "free software", "this (?:program|library|file) is free software you can redistribute it and or modify it"),
    ("public-domain", "public domain", "(?:is |are )?(?:released )?(?:in|into|to) the public domain"),
    ("reserved", "some rights", "some rights reserved"),
    ("copyright", "copyright", "copyright(?: c)?(?: ©)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("commercial", "commercial", "(?:for )?non ?commercial use only"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "permission", "(?:may not be|no part of this [^ ]+ may be) (?:reproduced|copied|distributed)(?: [^ ]+){0,8} without(?: the)?(?: prior)?(?: written)? permission"),
]
#: One of these stands in all normalised texts that a rule matches (fixed values).
TRIGGERS = (
    "licen", "reserved", "copyright", " cc  by ", "public  domain", "creative  commons", "spdx", "warrant", "permission", "redistribut", "free  software", "cc0", "gpl", "unlicense", "proprietary", "commercial", "as  is", "bsd", "contributors",
    "apache", " asl", " mpl", " epl", " cddl", " eupl", " bsl  1", " ofl", " odbl", "gfdl", "wtfpl", "distributed  under", "released  under", "available  under", "provided  under", "published  under",
)


@dataclass(frozen=True)
class Rule:
    """A rule's place in the order is its priority: of equal spans the earlier one counts."""

    place: int
    label: str
    keyword: str
    pattern: str
    confidence: float
    also: str = ""


def rules() -> list[Rule]:
    """The base phrases, the sentences, the SPDX identifiers, at the start of an expression and
    after "and" or "or" in a text that names SPDX, and in each context the families, the short
    forms and, but for the empty context, the names that need one; in order. A pattern is over
    text in which every word has a space of its own before and after it."""
    found: list[tuple[str, str, str, float, str]] = [(label, words.split()[-1] if label != "cc-by" else words, words, 0.8, "") for label, words in PHRASES.items()]
    found += [(label, keyword, words, 0.9, "") for label, keyword, words in SENTENCES]
    found += [(label, "spdx", f"spdx licen[cs]e identifier {words}", 1.0, "") for label, words in SPDX]
    found += [(label, "spdx", f"(?:and|or) {words}", 0.9, "") for label, words in SPDX if words not in EVERYDAY]
    for before, also in CONTEXTS:
        named = FAMILIES + SHORT + (UNDER if before else [])
        found += [(label, keyword, before + words, 1.0 if before else 0.7, also) for label, keyword, words in named]
    spaced = lambda words: f" {words.replace(' ?', '(?:  )?').replace(' ', '  ')} ".replace("(?:    )?", "(?:  )?")
    return [Rule(i, label, keyword, spaced(words), confidence, also) for i, (label, keyword, words, confidence, also) in enumerate(found)]


def normalised(text: Column) -> Column:
    """A space, the words, each two apart, and a space; one space for a text without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, "  ")), F.lit(" "))


def _words(part: Column) -> Column:
    """Words that end in a piece of normalised text: half its spaces."""
    return (F.octet_length(part) - F.octet_length(F.replace(part, F.lit(" "), F.lit("")))) / 2


_PLACES = "array<struct<start:bigint,end:bigint,place:int>>"


def _running(values: Column, join) -> Column:
    """Running sums or maxima of an array, by joining each item with the one 1, 2, 4, ... places
    before it: a whole new array for each power of two, so n items cost n log n."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    step = lambda a, k: F.transform(a, lambda x, i: join(x, F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("bigint"))))
    return F.aggregate(steps, values, step)


def _spans(norm: Column, rule: Column) -> Column:
    """All places of a rule, as ``(start, end, place)`` in words, by cutting the text at it: a
    match ends after as many words as the pieces and matches up to it hold."""

    def of(pieces: Column, found: Column) -> Column:
        own = F.transform(found, lambda f: _words(f).cast("bigint"))
        both = F.transform(own, lambda n, k: n + _words(F.get(pieces, k)).cast("bigint"))
        ends = let(both, lambda c: _running(c, lambda x, y: x + y))
        return F.zip_with(ends, own, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"), rule["place"].alias("place")))

    none = F.array().cast(_PLACES)
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(norm, rule["pattern"], -1), lambda p: of(p, f))))


def _unsuppressed(spans: Column) -> Column:
    """Spans that none contains: by start, longest first, then priority, a span is contained
    in an earlier one exactly if it doesn't end beyond all of them."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["place"].alias("place"))))

    def left(o: Column) -> Column:
        upto = _running(F.transform(o, lambda s: -s["less"]), F.greatest)
        return let(upto, lambda m: F.filter(o, lambda s, i: -s["less"] > F.coalesce(F.get(m, i - 1), F.lit(0).cast("bigint"))))

    return let(order, left)


def _table(value, schema: str) -> Column:
    """A table as one literal, so that a plan doesn't grow with the rules."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    Words are maximal runs of letters and digits, A-Z lowered, anything beyond ASCII being a
    letter. All rules whose keyword the text holds are matched over the whole text; of the
    places found, one that lies within another is suppressed, and of equal ones the earlier
    rule counts. ``labels`` are those of the places left and of the base phrases, which are
    counted wherever they stand; ``score`` is the confidence of the best place left. A null
    text counts as empty: no words, no labels, score 0. Rows are independent, so repeated ids,
    rows without one and an empty table need nothing; only the two named columns are read,
    whatever else the table has. Everything is a native expression of one narrow pass over
    the whole text: texts without a keyword cost one replacement and a few searches, others a
    search for each rule whose keywords they hold, and what is found is sorted and summed in
    time n log n of the number of places, so a very long text costs about its length.
    """
    table = rules()
    # rules by their two keywords, so that a text looks at those alone whose keywords it holds
    grouped: dict[tuple[str, str], list[Rule]] = {}
    for r in table:
        grouped.setdefault((r.keyword, r.also), []).append(r)
    groups = [{"keyword": k, "also": also, "rules": [{"place": r.place, "pattern": r.pattern} for r in rs]} for (k, also), rs in grouped.items()]
    listed = _table(groups, "array<struct<keyword:string,also:string,rules:array<struct<place:int,pattern:string>>>>")
    labels = _table([r.label for r in table], "array<string>")
    confidences = _table([r.confidence for r in table], "array<double>")
    base = len(PHRASES)

    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"))
    # keywords are looked for in words apart by one space, and only in texts that hold a trigger
    low = F.lower("_n")
    trigger = F.lit(False)
    for word in TRIGGERS:
        trigger = trigger | low.contains(word)
    rows = rows.select("doc_id", "_n", F.when(trigger, F.translate("_n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("_l"))
    none = F.array().cast(_PLACES)
    held = lambda t: F.filter(listed, lambda g: F.contains(t, g["keyword"]) & F.contains(t, g["also"]))
    wanted = let(F.replace(F.col("_l"), F.lit("  "), F.lit(" ")), lambda t: F.flatten(F.transform(held(t), lambda g: g["rules"])))
    places = F.flatten(F.transform(wanted, lambda r: _spans(F.col("_l"), r)))
    rows = rows.select("doc_id", "_n", F.when(F.col("_l").isNotNull(), places).otherwise(none).alias("_p"))
    of_base = F.filter("_p", lambda s: s["place"] < base)
    rows = rows.select("doc_id", "_n", of_base.alias("_b"), _unsuppressed(F.col("_p")).alias("_d"))
    label = lambda s: F.get(labels, s["place"])
    base_labels = F.array_sort(F.array_distinct(F.transform("_b", label)))
    all_labels = F.array_sort(F.array_distinct(F.concat(F.transform("_b", label), F.transform("_d", label))))
    return rows.select(
        "doc_id",
        F.when(F.col("_n") == "  ", F.lit(0)).otherwise(_words(F.col("_n"))).cast("bigint").alias("n_words"),
        F.size("_b").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_b", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("_b", lambda s: s["start"])).alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"),
        F.concat_ws(",", all_labels).alias("labels"),
        F.coalesce(F.array_max(F.transform("_d", lambda s: F.get(confidences, s["place"]))), F.lit(0.0)).alias("score"),
        F.concat_ws(",", F.transform("_d", lambda s: F.concat_ws(":", label(s), s["start"].cast("string"), (-s["less"]).cast("string")))).alias("detections"),
    )
