"""Document quality by a small convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Texts, text_slices
from .labelled import held_out, sample


@dataclass(frozen=True)
class Settings:
    """Windows of ``width`` bytes every ``stride`` bytes, ``filters`` filters, chunks of ``per_chunk`` windows.

    Training takes at most ``bad`` and ``good`` labelled documents of up to ``max_bytes`` each; whole
    ones, and scoring takes all bytes of all texts.
    """

    width: int = 16
    stride: int = 8
    depth: int = 8
    filters: int = 32
    hidden: int = 16
    per_chunk: int = 32
    bad: int = 1500
    good: int = 3000
    max_bytes: int = 60_000
    epochs: int = 8
    batch: int = 32
    rate: float = 3e-3
    threshold: float = 0.5
    seed: int = 5


def windows(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of bytes, chunks of each text).

    The windows of a text cover all of it and overlap; zeros lie behind its end, and its last window
    fills up its last chunk.  An empty text is one window of zeros.
    """
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - s.width) // s.stride) + 1)
    chunks = -(-n // s.per_chunk)
    room = (n - 1) * s.stride + s.width
    at = np.concatenate([[0], np.cumsum(room)])
    padded = np.zeros(at[-1], np.uint8)
    place = np.repeat(at[:-1] - offsets[:-1], sizes) + np.arange(len(data))
    padded[place] = data
    total = chunks * s.per_chunk
    first = np.concatenate([[0], np.cumsum(total)])[:-1]
    nth = np.minimum(np.arange(total.sum()) - np.repeat(first, total), np.repeat(n - 1, total))
    starts = np.repeat(at[:-1], total) + nth * s.stride
    return np.lib.stride_tricks.sliding_window_view(padded, s.width)[starts], chunks


class Network:
    """Byte vectors, filters with max-pooling in chunks, a hidden layer, and the mean over a text's chunks."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        put = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        wide = s.width * s.depth
        self.s = s
        self.p = {
            "bytes": put(256, s.depth, scale=0.5), "filters": put(wide, s.filters, scale=wide ** -0.5), "bias": np.zeros(s.filters, np.float32),
            "mix": put(s.filters, s.hidden, scale=s.filters ** -0.5), "mix_bias": np.zeros(s.hidden, np.float32),
            "out": put(s.hidden, scale=s.hidden ** -0.5), "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, data: np.ndarray, offsets: np.ndarray, keep: bool = False):
        s, p = self.s, self.p
        seen, chunks = windows(data, offsets, s)
        x = p["bytes"][seen].reshape(len(seen), -1)
        y = (x @ p["filters"] + p["bias"]).reshape(-1, s.per_chunk, s.filters)
        top = np.maximum(y.max(axis=1), 0)
        h = np.maximum(top @ p["mix"] + p["mix_bias"], 0)
        z = h @ p["out"] + p["out_bias"]
        first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
        logit = np.add.reduceat(z.astype(np.float64), first) / chunks
        return (logit, seen, x, y, top, h, chunks) if keep else logit

    def gradients(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        s, p = self.s, self.p
        logit, seen, x, y, top, h, chunks = self.forward(data, offsets, keep=True)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        dz = np.repeat(d / chunks, chunks).astype(np.float32)
        dh = np.outer(dz, p["out"]) * (h > 0)
        dtop = (dh @ p["mix"].T) * (top > 0)
        dy = np.zeros_like(y)
        np.put_along_axis(dy, y.argmax(axis=1)[:, None, :], dtop[:, None, :], axis=1)
        dy = dy.reshape(-1, s.filters)
        hit = np.flatnonzero(dy.any(axis=1))
        dx = (dy[hit] @ p["filters"].T).reshape(-1, s.depth)
        flat = seen[hit].ravel()
        return {
            "bytes": np.stack([np.bincount(flat, dx[:, i], 256) for i in range(s.depth)], axis=1).astype(np.float32),
            "filters": x[hit].T @ dy[hit], "bias": dy[hit].sum(axis=0), "mix": top.T @ dh, "mix_bias": dh.sum(axis=0), "out": h.T @ dz,
            "out_bias": dz.sum(keepdims=True),
        }


def train(labelled: list[tuple[str, int]], s: Settings = Settings()) -> Network | None:
    """A network by Adam on the log loss; None without examples of both classes."""
    if len({y for _, y in labelled}) < 2:
        return None
    net, rng = Network(s), np.random.default_rng(s.seed)
    raw = [t.encode() for t, _ in labelled]
    y = np.array([y for _, y in labelled], float)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, steps = 0, s.epochs * -(-len(raw) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(raw), s.batch):
            mine = order[at:at + s.batch]
            data = np.frombuffer(b"".join(raw[i] for i in mine), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in mine])])
            step += 1
            rate = s.rate * min(1.0, 2 * (1 - step / steps) + 0.05)
            for k, g in net.gradients(data, offsets, y[mine]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def judged(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document: how likely its quality label is 1.

    Null and empty texts are scored as one window of zeros; repeated rows each for itself; a null
    doc_id stays null and is not held out.  Null labels are not learnt from; without labels of both
    classes every score is one half.  An empty table gives no rows; other columns are ignored.
    """
    fold = held_out(3, 1)
    net = train(sample(docs, labels, "quality", fold, {0: s.bad, 1: s.good}, s.max_bytes), s)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_slices(batches, most=1 << 18):
            logit = sent.value.forward(texts.data, texts.offsets) if sent.value else np.zeros(len(texts))
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array((score >= s.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, score double, predicted int")
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")
