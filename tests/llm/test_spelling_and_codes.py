"""Spelling variants and vector codes against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veritrail.llm import spelling, vector_codes

from . import data


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    """Rows of the operator by the definition."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(close[w]), form[w] and n[form[w]]) for w in n), key=repr)


def found(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()), key=repr)


def test_errata_tries_find_all_pairs_once():
    rng = random.Random(1)
    for _ in range(500):
        letters = "abc"[: rng.choice([1, 2, 3])]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 25))}
        trie = spelling.Trie()
        for w in words:
            trie.add(w, w)
        got = [tuple(sorted((x, y))) for a, b in spelling.one_edit(trie) for x in a for y in b]
        assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


@pytest.mark.parametrize("full", [spelling.FULL, 3])
def test_variants_of_random_words(spark, full):
    """Words over few letters, so that most have near ones; with buckets of three words, ranges of
    places are halved down to one."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    words += ["a" * n for n in range(4, 12)] + ["ab" * 4, "ba" * 4, "x" * 300, "x" * 299 + "y", "x" * 301]
    rows = [(i if i % 9 else None, " ".join(rng.choice([w, w.capitalize(), w.upper()]) for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=300))) for i in range(40)]
    rows += [(1, " ".join(words)), (2, " ".join(words)), (3, "_".join(words)), (4, None), (5, ""), (5, "12 34 !")]
    docs = spark.createDataFrame([(*r, "clash", 1, 0) for r in rows], "doc_id int, text string, word string, n int, bucket int")
    assert found(spelling.variants(docs, full)) == variants(rows)


def test_variants_of_awkward_rows(spark):
    rows = [r[:2] for r in data.rows()]
    assert found(spelling.variants(data.documents(spark))) == variants(rows)
    assert spelling.variants(data.empty(spark)).count() == 0


def codes(rows, entries=64, rounds=2):
    """Codes by plain Lloyd rounds over whole integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    ints = np.array([[int(np.floor(256 * x)) for x in r[1]] for r in kept], dtype=object).reshape(len(kept), 16, -1)
    books = [[list(v) for v in ints[:entries, p]] for p in range(16)]

    def assigned():
        out = []
        for v in ints:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p], e)), i) for i, e in enumerate(books[p])) for p in range(16)])
        return out

    for _ in range(rounds):
        of = assigned()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [ints[k, p] for k in range(len(kept)) if of[k][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    of = assigned()
    total = Counter()
    for r, o in zip(kept, of):
        total[r[2]] += sum(d for d, _ in o)
    return [(r[0], "".join(f"{i:02x}" for _, i in o), sum(d for d, _ in o), total[r[2]]) for r, o in zip(kept, of)]


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_codes_are_those_of_plain_rounds(spark, spread):
    """Vectors so near to each other that most distances tie, and vectors far apart."""
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(scale=spread, size=32)], int(i) % 3 if i % 4 else None) for i in rng.permutation(150)]
    rows += [(200, None, 1), (201, [float("nan")] + [0.0] * 31, 1), (202, [None] + [0.0] * 31, 1), (203, [float("-inf")] * 32, None), (204, [0.0] * 32, 1), (205, [0.0] * 32, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, salt int")
    got = vector_codes.codes(table).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == codes(rows)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_bounds_leave_groups_out_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=300, size=(20, 64))
    x = np.floor(centres[rng.integers(20, size=3000)] + rng.normal(scale=20, size=(3000, 64))).astype(np.int64).reshape(3000, 16, 4)
    entries = x[:64].transpose(1, 0, 2).copy()
    books = vector_codes.Codebooks(entries, vector_codes.grouped(entries), np.zeros((16, vector_codes.GROUPS), dtype=np.int64))
    state, bounds, first = None, None, 0
    for k in range(4):
        state, bounds, best, work = vector_codes.assign(x, state, bounds, books)
        full = np.stack([vector_codes.squared(x[:, p], books.entries[p]) for p in range(16)], axis=1)
        assert (state == full.argmin(axis=2)).all() and (best == full.min(axis=2)).all()
        first = first or work
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros((16, 64), dtype=np.int64)
        for p in range(16):
            np.add.at(sums[p], state[:, p], x[:, p])
            counts[p] = np.bincount(state[:, p], minlength=64)
        books = books.moved(sums, counts)
    assert work < 0.6 * first


def test_codes_of_odd_tables(spark):
    shape = "vec_id bigint, embedding array<double>, label int"
    assert vector_codes.codes(spark.createDataFrame([], shape)).count() == 0
    few = [(2, [0.5] * 16, None), (1, [0.25] * 16, None), (1, [0.125] * 16, 7), (None, [0.5] * 16, 7), (3, [1.0] * 8, 7)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.codes(spark.createDataFrame(few, shape)).collect()}
    assert {(g[0], g[2]) for g in got} == {(2, 0), (1, 16 * 16**2), (1, 16 * 16**2), (None, 0), (3, 0)}
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.codes(spark.createDataFrame([(1, [1e12] * 16, 1)], shape)).count()
