"""Mix documents to target weights of soft domains: posteriors, then nonnegative rates by least squares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, Texts, record_batch, stored, text_slices
from .packing import encoder
from .seekable import blocks


@dataclass(frozen=True)
class Settings:
    """The domain classifier learns from at most ``train`` labelled documents of ``max_bytes`` bytes.  Of more than
    ``most_domains`` domains, those with the fewest of these documents are one domain, REST.

    ``evidence`` bytes of a text count as independent, which keeps posteriors soft.  Without given
    targets, domain k gets a weight of (its tokens) ** ``temperature``, and as many tokens in all that
    no domain shrinks.  The fit stops at ``tolerance`` of the targets' length or after ``rounds``.
    """

    train: int = 20_000
    max_bytes: int = 60_000
    most_domains: int = 64
    evidence: float = 30.0
    temperature: float = 0.7
    rounds: int = 60
    tolerance: float = 1e-4


#: The domain of all that are too rare for one of their own.
REST = "(rest)"


def _pairs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each two neighbouring bytes (ASCII lower-cased), and the text each belongs to."""
    data = _LOWER[texts.data].astype(np.int64)
    code = data[:-1] * 256 + data[1:]
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    inside = owner[:-1] == owner[1:]
    return code[inside], owner[:-1][inside]


@dataclass(frozen=True)
class Classifier:
    """Log likelihood of each pair of bytes in each domain, and the domains' log priors."""

    domains: list[str]
    weights: np.ndarray
    priors: np.ndarray

    def posteriors(self, texts: Texts, evidence: float) -> np.ndarray:
        codes, owner = _pairs(texts)
        n = np.bincount(owner, minlength=len(texts))
        logs = np.stack([np.bincount(owner, w[codes], len(texts)) for w in self.weights], axis=1)
        mean = logs / np.maximum(n, 1)[:, None]
        z = self.priors + mean * np.minimum(n, evidence)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame, domain: str, s: Settings = Settings()) -> Classifier:
    """A classifier of ``domain``, a column of documents, from those that the labelled table names.

    The rarest of more than ``most_domains`` domains are learnt as one, REST.  Without labelled documents
    there is one domain, "".
    """
    ids = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train)  # bounded by that parameter
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(domain).cast("string").alias("domain"))
    rows = rows.where(F.col("domain").isNotNull() & (F.octet_length("text") <= s.max_bytes)).join(F.broadcast(ids), "doc_id")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for part, texts in text_slices(batches):
            codes, owner = _pairs(texts)
            names = np.array(part.column("domain").to_pylist(), dtype=object)
            for name in set(names):
                held.setdefault(name, np.zeros(65537, np.int64))[:65536] += np.bincount(codes[(names == name)[owner]], minlength=65536)
                held[name][65536] += int((names == name).sum())
        for name, counts in held.items():
            code = np.flatnonzero(counts)
            yield record_batch(domain=pa.array([name] * len(code), pa.string()), code=code, n=counts[code])

    counts = stored(rows.mapInArrow(count, "domain string, code long, n long").groupBy("domain", "code").agg(F.sum("n").alias("n")), "pairs")
    most = counts.where("code = 65536").orderBy(F.desc("n"), "domain").limit(s.most_domains + 1).collect()
    domains = [r.domain for r in most]
    if len(domains) > s.most_domains:
        domains = domains[:s.most_domains - 1]
        own = F.when(F.col("domain").isin(domains), F.col("domain")).otherwise(F.lit(REST))
        counts = counts.groupBy(own.alias("domain"), "code").agg(F.sum("n").alias("n"))
        domains.append(REST)
    domains = sorted(set(domains))
    if not domains:
        return Classifier([""], np.zeros((1, 65536)), np.zeros(1))
    table = np.zeros((len(domains), 65537))
    found = counts.toArrow()  # at most 65,537 rows a domain
    table[[domains.index(d) for d in found.column("domain").to_pylist()], found.column("code").to_numpy()] = found.column("n").to_numpy()
    smooth = table[:, :65536] + 0.5
    return Classifier(domains, np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(table[:, 65536] / table[:, 65536].sum()))


def memberships(docs: DataFrame, model: Classifier, tokenizer: str, s: Settings = Settings()) -> DataFrame:
    """(doc_id, u, tokens, posteriors) of every row: its tokens by a tokenizers file, its domains, and a fixed draw in [0, 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tokens(text: str | None) -> int:
        return sum(len(encoder(tokenizer).encode([block])[0]) // 4 for block in blocks(text or ""))

    def work(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_slices(batches):
            p = sent.value.posteriors(texts, s.evidence)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]).astype(np.int32)), pa.array(p.ravel()))
            yield record_batch(doc_id=part.column("doc_id"), u=part.column("u"), tokens=np.array([tokens(x.as_py()) for x in part.column("text")], np.int64), posteriors=listed)

    return _keyed(docs).mapInArrow(work, "doc_id long, u double, tokens long, posteriors array<double>")


def _draw() -> F.Column:
    return (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)).alias("u")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _draw())


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of documents after these steps: each goes down the gradient and is cut at zero."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r - p @ step)
    return r


def copies(r: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rates as whole numbers, right on average over draws u; a rate within 1e-9 of a number is it."""
    whole = np.floor(r + 1e-9)
    return (whole + (u < r - whole)).astype(np.int64)


def _totals(members: DataFrame, steps: list[np.ndarray], k: int) -> np.ndarray:
    """Expected tokens of each domain under the rates: one row a task."""

    def work(batches):
        total = np.zeros(k)
        for b in batches:
            p = b.column("posteriors").flatten().to_numpy().reshape(-1, k)
            total += (rates(p, steps) * b.column("tokens").to_numpy()) @ p
        yield record_batch(k=np.arange(k), e=total)

    summed = members.select("tokens", "posteriors").mapInArrow(work, "k long, e double").groupBy("k").agg(F.sum("e").alias("e"))
    out = np.zeros(k)
    for r in summed.collect():
        out[r.k] = r.e
    return out


def fit(members: DataFrame, k: int, targets: np.ndarray | None = None, s: Settings = Settings()) -> tuple[list[np.ndarray], float]:
    """Steps of projected gradient that bring the domains' expected tokens to their targets, and the gap that remains,
    as a share of the targets' length: at most ``tolerance`` where the targets were met.

    The objective is half the squared distance between expected and target totals.  The gradient of a
    document's rate, by the token, is its posteriors times the distances, so a step is one number a
    domain: a document's rate is found from its own row, and a round moves one row a task.  A step is
    scaled by each domain's tokens at rate one, which bounds the curvature, so the distance falls.
    ``targets`` are tokens by domain; a domain without tokens is left out.
    """
    start = _totals(members, [], k)
    if targets is None:
        weights = np.where(start > 0, np.maximum(start, 1e-300) ** s.temperature, 0.0)
        targets = weights * max((a / b for a, b in zip(start, weights) if b > 0), default=0.0)
    steps: list[np.ndarray] = []
    now, length = start, max(float(np.linalg.norm(targets)), 1e-300)
    while True:
        gap = np.where(start > 0, now - targets, 0.0)
        left = float(np.linalg.norm(gap)) / length
        if left <= s.tolerance or len(steps) == s.rounds:
            return steps, left
        steps.append(np.divide(gap, start, out=np.zeros(k), where=start > 0))
        now = _totals(members, steps, k)


def mixed(docs: DataFrame, labels: DataFrame, tokenizer: str, domain: str = "lang", targets: dict[str, float] | None = None, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies, gap) of every document.

    domain is the likeliest one.  copies is the rate, rounded up or down by a draw fixed by id and
    text, so that it is the rate on average.  ``targets`` gives tokens by domain.  gap is the same in all rows: how
    far, as a share of the targets, the expected totals stay from them after ``rounds``.

    Null and empty texts have no tokens and the posteriors of the priors.  Repeated rows are rated
    each for itself; a null doc_id stays null.  An empty table gives no rows; other columns are ignored.
    """
    model = learn(docs, labels, domain, s)
    members = stored(memberships(docs, model, tokenizer, s), "memberships")
    k = len(model.domains)
    steps, gap = fit(members, k, None if targets is None else np.array([targets.get(d, 0.0) for d in model.domains]), s)

    def work(batches):
        for b in batches:
            p = b.column("posteriors").flatten().to_numpy().reshape(-1, k)
            r = rates(p, steps)
            best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
            yield record_batch(
                doc_id=b.column("doc_id"), n_tokens=b.column("tokens"), domain=pa.array([model.domains[i] for i in best], pa.string()),
                posterior=p[np.arange(len(p)), best], rate=r, copies=copies(r, b.column("u").to_numpy()), gap=np.full(len(p), gap))

    return members.mapInArrow(work, "doc_id long, n_tokens long, domain string, posterior double, rate double, copies long, gap double")


def resampled(docs: DataFrame, labels: DataFrame, tokenizer: str, domain: str = "lang", s: Settings = Settings()) -> DataFrame:
    """The rows of documents, each as often as its copies and once at least: the default targets shrink no domain."""
    model = learn(docs, labels, domain, s)
    k = len(model.domains)
    steps, _ = fit(stored(memberships(docs, model, tokenizer, s), "memberships"), k, None, s)
    sent, columns, draw = docs.sparkSession.sparkContext.broadcast(model), docs.columns, f"u_{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_slices(batches):
            r = rates(sent.value.posteriors(texts, s.evidence), steps)
            n = np.maximum(1, copies(r, part.column(draw).to_numpy()))
            for at in range(0, part.num_rows, 500):  # copies of long texts are sent in small parts
                rows = np.repeat(np.arange(at, min(at + 500, part.num_rows)), n[at:at + 500])
                yield part.select(columns).take(pa.array(rows))

    return docs.withColumn(draw, _draw()).mapInArrow(work, docs.schema)
