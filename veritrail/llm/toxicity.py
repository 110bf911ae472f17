"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, share, slices
from .shingles import shingles

#: Labelled documents of each class that training takes at most, about.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
#: Share of the toxic documents of the sample that a learnt cue is in, at least, and how many.
LEAST_SHARE, LEAST_DOCS = 0.01, 5
ROUNDS = 3
HEAD, STARTS = 4, (4, 5, 6, 7)
#: Insults and abuse, each a lexicon voter of its own (fixed values).
LEXICON = {
    "en": "idiot moron stupid scum trash loser clown pathetic worthless disgusting imbecile fool dumb filthy vermin",
    "de": "idiot dummkopf trottel abschaum versager widerlich arschloch schwachkopf",
    "fr": "idiot imbécile connard abruti crétin ordure salaud débile",
    "es": "idiota imbécil estúpido escoria basura asqueroso cretino tarado",
}
INSULTS = frozenset(" ".join(LEXICON.values()).split())
#: Patterns, each a voter: shouting, address with an insult's grammar, runs of marks (fixed values).
PATTERNS = {
    "shout": r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){4}",
    "marks": r"[!?]{3,}",
    "address": r"(?i)\b(?:you|du|tu|eres)\b\W+(?:\w+\W+){0,2}(?:" + "|".join(sorted(INSULTS)) + r")\b",
}
_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items()}
_WORD = re.compile(r"[^\W\d_]+")


def cues(text: str | None) -> set[str]:
    """Words of a text and, with a star, their starts of some lengths, lower case."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in STARTS if len(w) > n}


class LabelModel:
    """The generative model of votes (-1, 0 or 1) given a hidden label.

    Expectation-maximisation estimates how often each voter votes which way for either
    label, which is its propensity and accuracy, and the share of label 1. In the last round
    the correlations of voters within a label are estimated from what the model leaves
    unexplained, and a voter's evidence is divided by the number of voters it amounts to
    a copy of; otherwise several cues of one word would count as many opinions. Rounds are
    few: voters of different languages exclude each other, and in the long run the model
    takes that for evidence.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS):
        self.weight = np.ones(votes.shape[1])
        posterior = np.clip(start, 0.02, 0.98)
        often = np.stack([(votes == v).mean(axis=0) for v in (-1, 0, 1)], axis=1)
        for step in range(rounds):
            share_ = np.stack([1 - posterior, posterior]).astype(np.float32)
            self.prior = np.clip(share_.mean(axis=1), 0.005, 1)
            table = np.stack([share_ @ (votes == v).astype(np.float32) for v in (-1, 0, 1)], axis=2) + 0.05 * often + 1e-3
            self.table = table / table.sum(axis=2, keepdims=True)
            if step == rounds - 1:
                self.correlation = self._correlation(votes, share_)
                self.weight = 1 / (1 + np.clip(self.correlation, 0, 1).sum(axis=1))
            posterior = self.posterior(votes)

    def _correlation(self, votes: np.ndarray, shares: np.ndarray) -> np.ndarray:
        total = np.zeros((votes.shape[1],) * 2)
        for y in (0, 1):
            weight = shares[y][:, None]
            centred = (votes - (self.table[y] @ np.array([-1.0, 0, 1]))[None]) * np.sqrt(weight)
            total += centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
        out = total / spread[:, None] / spread[None]
        np.fill_diagonal(out, 0)
        return np.where(out > 0.1, out, 0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table) * self.weight[:, None]
        pick = sum((votes == v).astype(np.float32) @ logs[:, :, v + 1].T for v in (-1, 0, 1)).T
        odds = pick[1] - pick[0] + np.log(self.prior[1] / self.prior[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(x: np.ndarray, target: np.ndarray, penalty: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes of equal weight, weights at least 0."""
    toxic = max(1e-6, target.mean())
    weight = target / (2 * toxic) + (1 - target) / (2 * max(1e-6, 1 - toxic))
    target, weight = target.astype(np.float32), weight.astype(np.float32)
    w, b, speed = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(4 / (1 + float(weight @ (x * x).sum(axis=1)) / len(x)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = weight * (p - target) / len(x)
        speed = np.float32(0.9) * speed - rate * np.append(g @ x + np.float32(penalty) * w, g.sum())
        w, b = np.maximum(0, w + speed[:-1]), b + float(speed[-1])
    return w, b


class Classifier:
    """A linear model over the presence of cues. It keeps the texts' cues only as far as a
    word's first letters can match one."""

    def __init__(self, weights: dict[str, float], offset: float):
        self.weights, self.offset = weights, offset
        self.heads = {c.rstrip("*")[:HEAD] for c in weights}

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        heads, weights = self.heads, self.weights
        near = {w for w in set(_WORD.findall((text or "").lower())) if w[:HEAD] in heads}
        found = near | {f"{w[:n]}*" for w in near for n in STARTS if len(w) > n}
        total = self.offset + sum(weights[c] for c in sorted(found) if c in weights)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic``: labelled documents outside the held-out fold, chosen by a hash of the
    id at a rate that makes the documented numbers of rows; of several labels of an id the
    highest counts. The ids chosen are so few that they may be broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, TRAIN_TOXIC / max(1, n.get(1, 0)))).otherwise(min(1.0, TRAIN_CLEAN / max(1, n.get(0, 0))))
    chosen = known.where(share() < rate).limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return cut(rows.mapInArrow(_keyed, "text string, toxic int, group binary").groupBy("group", "toxic").agg(F.min("text").alias("text")))


def _keyed(batches):
    """Adds the least hash of a text's 3-word shingles: near copies mostly share it, and one
    of them is enough, else the words of a large group of copies would pass for cues."""
    for batch in slices(batches):
        found = [shingles(t, 3) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[:1].tobytes() for f in found], pa.binary())], names=["text", "toxic", "group"])


def _cue_counts(batches):
    counts = (Counter(), Counter())
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(cues(text))
    names = sorted(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in counts)], names=["cue", "clean", "toxic"])
    rest = sorted(counts[0].keys() - counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([counts[0][k] for k in rest], pa.int64()), pa.array([0] * len(rest), pa.int64())], names=["cue", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Voters are the hand-written lexicon and patterns, every cue that the labelled sample
    shows to go with toxicity, their silence, which votes for label 0, and the annotator, whose
    accuracy is estimated as the others' is. The label model starts from what the text alone
    says (any cue or none), and the classifier is trained on its posterior labels."""
    rows = sample(docs, labels)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Classifier({}, 0.0)
    counts = rows.mapInArrow(_cue_counts, "cue string, clean bigint, toxic bigint").groupBy("cue").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate1, rate0 = F.col("toxic") / n[1], F.col("clean") / n[0]
    spread = F.sqrt((F.col("toxic") + F.col("clean")) / (n[0] + n[1]) * (1 / n[1] + 1 / n[0]))
    z = (rate1 - rate0) / spread
    chosen = counts.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * n[1])) & (rate1 > 10 * rate0)).where(z > 3)
    found = [r.cue for r in chosen.select("cue").collect()]
    names = sorted(INSULTS.union(found))
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def hits(batches):
        place = {c: i for i, c in enumerate(shared.value)}
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cue = [sorted(place[c] for c in cues(t) if c in place) for t in texts]
            pattern = [[bool(p.search(t)) for p in _PATTERNS.values()] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cue, pa.list_(pa.int32())), pa.array(pattern, pa.list_(pa.bool_())), pa.array([len(t) for t in texts], pa.int64()), batch.column("toxic")],
                names=["cue", "pattern", "size", "toxic"],
            )

    made = rows.mapInArrow(hits, "cue array<int>, pattern array<boolean>, size bigint, toxic int").collect()
    x = np.zeros((len(made), len(names)), dtype=np.float32)
    for i, r in enumerate(made):
        x[i, r.cue] = 1
    patterns = np.array([r.pattern for r in made]).reshape(len(made), -1)
    silent = np.where((x.sum(axis=1) == 0) & (np.array([r.size for r in made]) > 0), -1, 0)
    annotator = 2 * np.array([r.toxic for r in made]) - 1
    votes = np.column_stack([x, patterns, silent, annotator]).astype(np.int8)
    model = LabelModel(votes, np.where(x.any(axis=1), 0.9, 0.1))
    w, b = _logistic(x, model.posterior(votes))
    return Classifier({c: float(v) for c, v in zip(names, w) if v > 1e-4}, b)


def assess(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of (doc_id, text).

    Without a ``model``, one is trained on ``docs`` and ``labels``. Scores look at the whole
    text alone; null and empty texts get the model's offset, and 0 if nothing can be learnt.
    A null id counts as held out; repeated rows get equal results; an empty table gives an
    empty one; other columns, whatever they are called, aren't looked at. Time and memory are
    linear in the length of a text.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches):
        for batch in slices(batches):
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (fold() == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, that score less than ``most``: null and empty texts
    too if the model's offset does; repeated rows go or stay together; an empty table gives
    an empty one. Texts are read whole, of any length; other columns, of whatever names, pass through."""
    model = train(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.score(t) < most for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
