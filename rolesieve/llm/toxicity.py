"""Toxic documents by multiple-instance learning: sentences are judged, only documents are labelled."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, sample


@dataclass(frozen=True)
class Settings:
    """A sentence is toxic with probability sigmoid(leak + the weights of its words' features).

    Training takes at most ``toxic`` and ``clean`` labelled documents of up to ``max_bytes`` each.
    ``leak`` is the log-odds of a sentence without evidence.  A document's noisy-or is over what its
    sentences have beyond that, so sentences without evidence add nothing, however many there are.
    Evidence up to a margin is none, as a long clean text has thousands of sentences with a little: the
    margin is fitted so that all clean training texts, read ``repeats`` times as one, stay at ``long_clean``; evidence
    beyond it is stretched so that what made a sentence's probability one half still does.  The last
    ``refined`` epochs train with the margin, so training and scoring use one formula.
    """

    toxic: int = 1500
    clean: int = 3000
    max_bytes: int = 60_000
    features: int = 1 << 18
    leak: float = -10.0
    epochs: int = 150
    refined: int = 10
    long_clean: float = 0.15
    repeats: int = 1000
    rate: float = 0.25
    shrink: float = 2e-4
    threshold: float = 0.3
    offending: float = 0.5
    remembered: int = 300_000


_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def features(word: str, n: int) -> list[int]:
    """Buckets of a word: itself and its runs of four and of five characters."""
    out = [zlib.crc32(f"={word}".encode()) % n]
    for k in (4, 5):
        out += [zlib.crc32(word[i:i + k].encode()) % n for i in range(len(word) - k + 1)]
    return out


def _bags(texts: list[str], n: int):
    """Words of all sentences by number, where sentences and documents begin, and the words' features."""
    numbers: dict[str, int] = {}
    words, sentences, bags = [], [], []
    for text in texts:
        bags.append(len(sentences))
        for m in _SENTENCE.finditer(text.lower()):
            own = _WORD.findall(m[0])
            if own:
                sentences.append(len(words))
                words += [numbers.setdefault(w, len(numbers)) for w in own]
    listed = [features(w, n) for w in numbers]
    return np.array(words, np.int64), np.array(sentences, np.int64), np.array(bags, np.int64), listed


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the evidence up to which a sentence has none."""

    weights: np.ndarray
    margin: float = 0.0


def log_odds(evidence, margin: float, leak: float):
    """Of sentences with so much evidence; continuous and never falling."""
    return np.clip(leak + np.maximum(evidence - margin, 0) * (leak / (leak + margin)), -30, 30)


def _fitted_margin(evidence: np.ndarray, in_bag: np.ndarray, y: np.ndarray, s: Settings) -> float:
    """The smallest margin at which the clean documents, ``repeats`` times as one text, score at most ``long_clean``.

    Those that score ``threshold`` alone, with no margin, are left out: their labels or the weights are wrong.
    """
    none = np.logaddexp(0, s.leak)
    starts = np.concatenate([[0], np.cumsum(in_bag)])[:-1]
    alone = np.add.reduceat(np.logaddexp(0, log_odds(evidence, 0.0, s.leak)) - none, starts)
    clean = evidence[np.repeat((y == 0) & (-np.expm1(-alone) < s.threshold), in_bag)]
    low, high = 0.0, -0.9 * s.leak
    for _ in range(40):
        at = (low + high) / 2
        beyond = s.repeats * (np.logaddexp(0, log_odds(clean, at, s.leak)) - none).sum()
        low, high = (low, at) if beyond <= -np.log1p(-s.long_clean) else (at, high)
    return float(high)


def train(labelled: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """Full-batch Adam on the noisy-or likelihood, weights shrunk towards zero; then the margin, and epochs with it.

    A toxic document's gradient goes to the sentences that look worst, a clean one's to all.  Without
    examples of both classes all weights are zero.
    """
    w = np.zeros(s.features)
    labelled = [(t, y) for t, y in labelled if _WORD.search(t)]
    if len({y for _, y in labelled}) < 2:
        return Model(w.astype(np.float32))
    words, sentences, bags, listed = _bags([t for t, _ in labelled], s.features)
    y = np.array([y for _, y in labelled], float)
    flat = np.concatenate([np.array(f) for f in listed])
    first = np.concatenate([[0], np.cumsum([len(f) for f in listed])])[:-1]
    per_word = np.diff(np.append(first, len(flat)))
    in_sentence = np.diff(np.append(sentences, len(words)))
    in_bag = np.diff(np.append(bags, len(sentences)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    none = np.logaddexp(0, s.leak)
    evidence = lambda: np.add.reduceat(np.add.reduceat(w[flat], first)[words], sentences)
    margin = 0.0
    for step in range(1, s.epochs + s.refined + 1):
        e = evidence()
        if step == s.epochs + 1:
            margin = _fitted_margin(e, in_bag, y, s)
        z = log_odds(e, margin, s.leak)
        p = 1 / (1 + np.exp(-z))
        beyond = none - np.logaddexp(0, z)  # log of (1 - p) / (1 - sigmoid(leak))
        if not margin:
            beyond = np.minimum(beyond, 0)
        clean = np.add.reduceat(beyond, bags)
        # A toxic document that has no evidence yet asks the same of all its sentences.
        share = np.where(y == 1, np.exp(clean) / np.maximum(-np.expm1(clean), in_bag * -np.expm1(-none)), -1.0)
        dz = np.repeat(share, in_bag) * p
        if margin:
            dz *= (e > margin) * (s.leak / (s.leak + margin))
        by_word = np.bincount(words, np.repeat(dz, in_sentence), len(first))
        g = np.bincount(flat, np.repeat(by_word, per_word), s.features) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += s.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - s.rate * s.shrink / (np.sqrt(v) + 1e-4), 0)
    # The weights have moved on since the margin was fitted: it is never less than they ask for.
    return Model(w.astype(np.float32), max(margin, _fitted_margin(evidence(), in_bag, y, s)))


class Judge:
    """Scores sentences with trained weights; remembers the scores of words."""

    def __init__(self, model: Model, s: Settings):
        self.weights, self.margin, self.s, self.known = model.weights, model.margin, s, {}
        self.none = float(np.logaddexp(0.0, s.leak))
        self.stretch = s.leak / (s.leak + model.margin)

    def _word(self, word: str) -> float:
        if len(self.known) >= self.s.remembered:
            self.known.clear()
        score = self.known[word] = float(self.weights[features(word, self.s.features)].sum())
        return score

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences' evidence, and (start, end, score) of the offending ones."""
        clean, found = 0.0, []
        known, word, leak, margin = self.known, self._word, self.s.leak, self.margin
        lowered = text.lower()
        same = len(lowered) == len(text)  # else positions are looked up in the text as it is
        for m in _SENTENCE.finditer(lowered if same else text):
            e = 0.0
            for w in _WORD.findall(m[0] if same else m[0].lower()):
                x = known.get(w)
                e += word(w) if x is None else x
            if e <= margin:
                continue
            z = min(leak + (e - margin) * self.stretch, 30.0)
            clean -= float(np.logaddexp(0.0, z)) - self.none
            if z >= 0 and (p := 1 / (1 + np.e ** -z)) >= self.s.offending:
                found.append((m.start(), m.end(), p))
        return -float(np.expm1(clean)), found


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score, predicted, sentences) of (doc_id, text): sentences are the offending spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]):
        judge = Judge(sent.value, s)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [judge.document(t or "") for t in batch.column("text").to_pylist()]
                scores = [p for p, _ in made]
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in made]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(p >= s.threshold) for p in scores], pa.int32()),
                     pa.array(spans, kind)], names=["doc_id", "score", "predicted", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from the labelled rows that are not held out."""
    return train(sample(docs, labels, "toxic", held_out(4, 2), {1: s.toxic, 0: s.clean}, s.max_bytes), s)


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) of every document.

    Null and empty texts have no sentences and score 0.  Repeated rows are scored each for itself.  A
    null doc_id stays null and is not held out.  Null labels are not learnt from; without labels of
    both classes every score is 0.  An empty table gives no rows;
    other columns are ignored.
    """
    return score(docs, learn(docs, labels, s), s).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted", "sentences")


def clean_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of documents that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, s))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]):
        judge = Judge(sent.value, s)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                yield batch.filter(pa.array([judge.document(t or "")[0] < s.threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
