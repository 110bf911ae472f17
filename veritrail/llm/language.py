"""Language identification: the family first, then linear SVMs between its languages."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, share, slices

#: Families of related languages by language code (fixed values); others stand alone.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he am mt",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
UNKNOWN = "und"
DIMENSIONS = 1 << 14
#: Documents that training takes at most, about: of each language, and of all together.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 800, 16_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(text: str | None) -> tuple[np.ndarray, int] | None:
    """Counts of the hashed byte 3-grams and their number; None without a letter. Letters are
    lowered and runs of anything else become one space."""
    if not text or not (text.isalpha() or any(c.isalpha() for c in text)):
        return None
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    raw = np.where(_LETTER[raw], raw, np.uint8(32))
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep].astype(np.uint32)
    if len(b) < 3:
        return None
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS), len(h)


class Rows:
    """Sparse rows: sorted feature numbers and values of length 1, end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(i) for i, _ in rows], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.index = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.uint16)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of ``rows``, and for each which of the rows it is of."""
        size = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[rows], size)
        return self.index[at], self.value[at], owner

    def margins(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        index, value, owner = self.pick(rows)
        return np.bincount(owner, value * w[index], minlength=len(rows))


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The features that a text has, and its counts of them scaled to length 1."""
    found = features(text)
    if found is None:
        return None
    index = np.flatnonzero(found[0])
    value = found[0][index].astype(np.float32)
    return index.astype(np.uint16), value / np.linalg.norm(value)


def _svm(x: Rows, rows: np.ndarray, y: np.ndarray, epochs: int = 8, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of a linear SVM without offset (averaged sub-gradient steps on the hinge loss
    of ``rows``) and the factor of a logistic curve over its margins."""
    rng, step = np.random.default_rng(7), 0
    w, mean = np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32)
    balance = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) / 2
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            step += 1
            rate = 1 / (penalty * (step + 1000))
            index, value, owner = x.pick(rows[part])
            wrong = y[part] * np.bincount(owner, value * w[index], minlength=len(part)) < 1
            w *= 1 - rate * penalty
            if wrong.any():
                pull = np.where(wrong, y[part] * balance[part], 0.0) * (rate / len(part))
                w += np.bincount(index, value * pull[owner], minlength=DIMENSIONS).astype(np.float32)
            if epoch >= epochs // 2:
                mean += w
    mean /= max(1, np.linalg.norm(mean))
    margin, scale = y * x.margins(rows, mean), 1.0
    best = np.inf
    for s in 2.0 ** np.arange(-2, 12):
        loss = np.logaddexp(0, -s * np.clip(margin, -20, 20)).mean() + 1e-6 * s
        if loss < best:
            best, scale = loss, float(s)
    return mean, scale


class Model:
    """A family is chosen by one-versus-one SVMs between families, a language by those
    between the languages of that family alone. Scores are products of the two shares, each
    that against the strongest rival."""

    def __init__(self, made: list[tuple[tuple[np.ndarray, np.ndarray], str]]):
        """From what :func:`sparse` gives for a text, and its language."""
        self.langs = sorted({lang for _, lang in made})
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        x = Rows([f for f, _ in made])
        lang = np.array([lang for _, lang in made], dtype=object)
        family = np.array([FAMILY_OF.get(g, g) for g in lang], dtype=object)
        self.pairs: list[tuple[str, str, float]] = []
        weights = []
        for names, values in [(sorted(self.families), family), *((g, lang) for g in self.families.values())]:
            for a, b in itertools.combinations(names, 2):
                rows = np.flatnonzero((values == a) | (values == b))
                w, scale = _svm(x, rows, np.where(values[rows] == a, 1.0, -1.0))
                self.pairs.append((a, b, scale))
                weights.append(w)
        self.weights = np.array(weights, dtype=np.float32).reshape(-1, DIMENSIONS).T.copy()

    def predict(self, text: str | None) -> tuple[str, float]:
        found = sparse(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        margins = found[1] @ self.weights[found[0]]
        win = {(a, b): 1 / (1 + np.exp(-np.clip(s * m, -30, 30))) for (a, b, s), m in zip(self.pairs, margins)}
        family, p = _choose(sorted(self.families), win)
        lang, q = _choose(self.families[family], win)
        return lang, float(p * q)


def _choose(names: list[str], win: dict) -> tuple[str, float]:
    """The name with the most won pairs, the sum of shares deciding ties, and its share in the
    pair it does worst in, which is 1 if all are won outright, however many names there are."""
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, worst = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for a, b in itertools.combinations(names, 2):
        p = win[a, b]
        votes[a if p >= 0.5 else b] += 1
        for name, q in ((a, p), (b, 1 - p)):
            sums[name] += q
            worst[name] = min(worst[name], q)
    best = max(names, key=lambda n: (votes[n], sums[n]))
    return best, float(worst[best])


def _featured(batches):
    """Sparse features as bytes, so that the driver holds no texts and no Python numbers."""
    for batch in slices(batches):
        made = [(f, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if (f := sparse(t)) is not None]
        columns = [[i.tobytes() for (i, _), _ in made], [v.tobytes() for (_, v), _ in made], [g for _, g in made]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.string()))], names=["index", "value", "lang"])


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, rows: int = TRAIN_ROWS) -> Model:
    """Fits a model to a sample of rows with a language outside the held-out fold: rows are
    counted by language, and each language gives those whose id's hash is below the share
    that makes ``per_language`` rows, or fewer if all languages together would pass ``rows``,
    so the sample doesn't grow with the table. A row comes to the driver as its features, at
    most DIMENSIONS of them whatever the length of its text."""
    usable = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([])
    each = max(1, min(per_language, rows // len(counts)))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (share() < min(1.0, each / n)))
    chosen = usable.where(wanted).select("text", "lang").mapInArrow(_featured, "index binary, value binary, lang string").limit(2 * each * len(counts))
    return Model([((np.frombuffer(r["index"], np.uint16), np.frombuffer(r["value"], np.float32)), r["lang"]) for r in chosen.collect()])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of (doc_id, text, lang).

    Without a ``model``, one is trained on ``docs``. Prediction looks at the whole text and
    nothing else; a null text, or one without a letter, is ``und`` with score 0, and so is
    every row when nothing can be learnt from. A null id counts as held out. Repeated rows
    get equal results; an empty table gives an empty one; other columns, whatever they are
    called, aren't looked at. Memory is linear in the longest text, time in all of them.
    """
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches):
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose language is known: some letter, and a score
    of ``least`` or more. If nothing can be learnt from ``docs``, rows with a letter stay. Null
    and letterless texts go; repeated rows go or stay together; an empty table gives an empty
    one. Texts are read whole, of any length; other columns, of whatever names, pass through."""
    model = train(docs.select("doc_id", F.col(text_col).alias("text"), "lang"))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if shared.value.langs:
                keep = [s >= least and lang != UNKNOWN for lang, s in map(shared.value.predict, texts)]
            else:
                keep = [features(t) is not None for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
