import re
import time

import pytest
from pyspark.sql import functions as F

from veritrail.llm import licenses, quality

from . import brute, data


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_license_base(spark):
    docs = data.documents(spark)
    found = licenses.scan(docs)
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.collect()), key=repr)
    assert got == sorted((brute.license_base(r[1]) for r in data.rows()), key=repr)
    assert licenses.scan(data.empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("the mitten licensed nothing", ""),
        ("Copyright (c) 2019 Someone. All rights reserved.", "copyright,reserved"),
    ],
)
def test_license_rules(spark, text, labels):
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert found.labels == labels and 0 <= found.score <= 1


def test_containment(spark):
    found = licenses.scan(spark.createDataFrame([(1, "x licensed under the Apache License 2.0 y Apache License")], "doc_id int, text string")).first()
    assert found.detections == "apache-2.0:1:8,apache:9:11"


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 300 and len({r.place for r in licenses.rules()}) == len(licenses.rules())


def matched(tree):
    """Texts that a parsed pattern matches: each alternative, with and without what is optional."""
    texts = [""]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            found = [chr(value)]
        elif name == "NOT_LITERAL":
            found = ["w"]
        elif name == "IN":
            found = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
        elif name == "BRANCH":
            found = [t for part in value[1] for t in matched(part)]
        elif name == "SUBPATTERN":
            found = matched(value[3])
        elif name == "MAX_REPEAT":
            least, _, part = value
            found = [t * n for n in {least, max(1, least)} for t in (matched(part) if n else [""])]
        else:
            raise ValueError(name)
        texts = [a + b for a in texts for b in found]
    return texts


def expanded(rule):
    """Texts of a rule; what stands after "and" or "or" counts only in a text that names SPDX."""
    after = rule.keyword == "spdx" and rule.pattern.startswith(" (?:and|or)")
    return [" spdx " * after + text for text in matched(re._parser.parse(rule.pattern))]


def test_every_alternative_of_a_rule_passes_its_keyword_and_a_trigger():
    for rule in licenses.rules():
        for text in expanded(rule):
            assert re.search(rule.pattern, text), (rule, text)
            assert rule.keyword in text.replace("  ", " ") and rule.also in text.replace("  ", " "), (rule, text)
            assert any(t in text for t in licenses.TRIGGERS), (rule, text)


@pytest.mark.parametrize("name", ["X11 License", "Expat License", "GNU Library General Public License"])
def test_names_without_the_usual_keyword(spark, name):
    found = licenses.scan(spark.createDataFrame([(1, name)], "doc_id int, text string")).first()
    assert found.labels == ("gpl,lgpl" if "GNU" in name else "mit") and found.score == 0.7


def test_every_rule_fires(spark):
    """A text of each rule alone, where no earlier rule says the same, gives its label."""
    table = licenses.rules()
    assert len({r.pattern for r in table}) == len(table)
    docs = [(r.place, t.strip().replace("  ", " ")) for r in table for t in (max(expanded(r), key=len), min(expanded(r), key=len))]
    found = licenses.scan(spark.createDataFrame(docs, "doc_id int, text string").repartition(4)).collect()
    labels = {}
    for r in found:
        labels.setdefault(r.doc_id, set()).update(r.labels.split(","))
        assert r.score > 0
    assert [r for r in table if r.label not in labels[r.place]] == []


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
        ("SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("SPDX-License-Identifier: (Apache-2.0 OR MIT)", "apache-2.0,mit"),
        ("SPDX-License-Identifier: CC0-1.0", "cc0"),
        ("Apache-2.0", "apache-2.0"),
        ("MPL-2.0", "mpl-2.0"),
        ("LGPL-2.1-only", "lgpl-2.1"),
        ("covered by the LGPL", "lgpl"),
        ("see the AGPLv3", "agpl-3.0"),
        ("This is licensed under MIT.", "mit"),
        ("dual licensed under the Apache 2 terms", "apache-2.0"),
        ("released under ISC", "isc"),
        ("a simple example of replacing an apache helicopter, mit einem Wort", ""),
    ],
)
def test_identifiers_and_abbreviations(spark, text, labels):
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert found.labels == labels and (found.score > 0) == bool(labels)


def test_quality_base(spark):
    found = quality.judged(data.documents(spark))
    assert "Python" not in plan(found) and "Arrow" not in plan(found)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(tuple(r[n] for n in names) for r in found.collect())
    assert got == sorted(brute.quality_base(r[1]) for r in data.rows())
    assert all(not (r.base_failed and r.kept) for r in found.collect())
    assert quality.judged(data.empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    ledger = quality.ledger(data.documents(spark)).cache()
    for version, rules in quality.POLICIES.items():
        kept = ledger.where(quality.kept_by(version)).count()
        for r in quality.ablations(ledger, version).collect():
            bit = quality.mask([r.rule])
            others = quality.mask([n for n in rules if n != r.rule])
            assert r.failing == ledger.where(F.col("failure_bits").bitwiseAND(F.lit(bit)) != 0).count()
            assert r.kept_without == ledger.where(F.col("failure_bits").bitwiseAND(F.lit(others)) == 0).count()
            assert r.kept_without - kept == r.failing_alone


def test_license_scan_of_a_megabyte_of_matches(spark):
    """Four times the text takes about four times as long, besides planning."""
    seconds = []
    for n in (1, 40_000, 160_000):
        began = time.perf_counter()
        found = licenses.scan(spark.createDataFrame([(1, "cc by, " * n)], "doc_id int, text string")).first()
        seconds.append(time.perf_counter() - began)
        assert (found.n_words, found.n_base, found.first_word, found.last_word, found.base_labels) == (2 * n, n, 0, 2 * n - 2, "cc-by")
    assert seconds[2] < 6 * max(seconds[1], 2) and seconds[2] < 60
