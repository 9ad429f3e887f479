"""Hard negatives by exact integer inner products, filtered by summaries of vector segments.

Of every segment of a vector its mean and deviation are stored.  For a segment of length L,
``L * mean * mean' +- L * deviation * deviation'`` bounds the inner product (Cauchy and Schwarz), and
segments joined in pairs of pairs have summaries that follow from their parts'.  A block of anchors
meets a block of rows with one segment, then 4, then 16; then groups of segments are refined to their
components, the rest staying bounded, until what is left is exact.  A row is dropped as soon as its
bounds show that it can't be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import record_batch, stored


@dataclass(frozen=True)
class Settings:
    """``positives`` of each anchor, ``k`` negatives of each positive; a negative's score lies between
    ``least_percent`` and 100 percent of the positive's.  ``segments`` is the finest number of segments,
    ``fan`` how many are joined a level up.  Blocks hold ``rows`` rows and ``anchors`` anchors.
    """

    positives: int = 5
    k: int = 5
    least_percent: int = 80
    scale: int = 256
    segments: int = 16
    fan: int = 4
    rows: int = 8192
    anchors: int = 1024


#: A row of greater squared length has inner products that 64 bits don't hold.
MOST_SQUARED = float(1 << 62)
_SUMMED = "vec_id long, label long, v array<long>, mean array<double>, deviation array<double>"
_FOUND = "anchor_id long, band long, vec_id long, score long, seen long, exact long"


def edges(dim: int, n: int) -> np.ndarray:
    """Where n nearly equal segments of ``dim`` components begin and end."""
    return np.linspace(0, dim, min(n, dim) + 1).astype(np.int64)


def summaries(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, segments) means and deviations."""
    length = np.diff(cut)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / length
    spread = x - np.repeat(mean, length, axis=1)
    return mean, np.sqrt(np.add.reduceat(spread * spread, cut[:-1], axis=1) / length)


def coarser(mean: np.ndarray, deviation: np.ndarray, length: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summaries of every ``fan`` neighbouring segments joined, from their own."""
    at = np.arange(0, len(length), fan)
    total = np.add.reduceat(length, at)
    joined = np.add.reduceat(mean * length, at, axis=1) / total
    off = mean - np.repeat(joined, np.diff(np.append(at, len(length))), axis=1)
    return joined, np.sqrt(np.add.reduceat((deviation ** 2 + off ** 2) * length, at, axis=1) / total), total


class Block:
    """Vectors with their summaries, from the coarsest level to the finest, in the form products need."""

    def __init__(self, v: np.ndarray, mean: np.ndarray, deviation: np.ndarray, fan: int):
        self.v = v
        self.x = v.astype(np.float64)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        cut = edges(v.shape[1], mean.shape[1])
        length = np.diff(cut)
        self.cut, self.levels = cut, []
        while True:
            root = np.sqrt(length)
            self.levels.insert(0, (mean * root, deviation * root))
            if len(length) == 1:
                break
            mean, deviation, length = coarser(mean, deviation, length, fan)

    @property
    def whole(self) -> bool:
        """Whether products of these vectors are whole numbers that doubles hold."""
        return not len(self.norm) or float(self.norm.max()) < 2.0 ** 26


def bounded(a: Block, b: Block, mine: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Exact scores of the pairs of some anchors of ``a`` with rows of ``b`` that outlive all bounds.

    ``keep(upper, lower, alive)`` says which pairs may still matter; ``alive`` is (anchors, rows) at
    first and its columns shrink to the rows any anchor still needs.  Returns the anchors' places, the
    rows' places, the scores, and how many pairs were scored exactly.
    """
    alive = np.ones((len(mine), len(b.v)), bool)
    alive = keep(None, None, alive, np.arange(len(b.v)))
    cols = np.flatnonzero(alive.any(axis=0))
    alive = alive[:, cols]
    slack = lambda: 1e-9 * a.norm[mine, None] * b.norm[None, cols] + 1e-6

    def narrowed(middle, width, also=()):
        nonlocal alive, cols
        width = width + slack()
        alive &= keep(middle + width, middle - width, alive, cols)
        left = np.flatnonzero(alive.any(axis=0))
        if len(left) < len(cols):
            alive, cols = alive[:, left], cols[left]
            return [x[:, left] for x in also]
        return list(also)

    for (am, ad), (bm, bd) in zip(a.levels, b.levels):
        if not len(cols):
            break
        narrowed(am[mine] @ bm[cols].T, ad[mine] @ bd[cols].T)
    (am, ad), (bm, bd) = a.levels[-1], b.levels[-1]
    n = am.shape[1]
    done = np.zeros(alive.shape)
    group = max(1, -(-n // 4))
    for at in range(group, n, group):
        if not len(cols) or alive.sum() * 8 < alive.size:
            break
        left, right = a.cut[at - group], a.cut[at]
        done = done + a.x[mine, left:right] @ b.x[cols, left:right].T
        done, = narrowed(done + am[mine, at:] @ bm[cols, at:].T, ad[mine, at:] @ bd[cols, at:].T, [done])
    i, j = np.nonzero(alive)
    if not len(i):
        score = np.empty(0, np.int64)
    elif a.whole and b.whole and alive.sum() * 8 >= alive.size:
        score = np.rint((a.x[mine] @ b.x[cols].T)[i, j]).astype(np.int64)
    else:
        score = np.concatenate([np.einsum("ij,ij->i", a.v[mine[i[o:o + 65536]]], b.v[cols[j[o:o + 65536]]]) for o in range(0, len(i), 65536)])
    return mine[i], cols[j], score, len(i)


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the k-th largest value, or minus infinity where there are fewer."""
    if x.shape[1] < k:
        return np.full((len(x), 1), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k, None]


def best_of_label(a: Block, b: Block, ids: tuple, labels: tuple, k: int):
    """Per anchor the k best other rows of its label; yields (anchor, row, score, pairs, exact)."""
    for label in np.unique(labels[0]):
        mine, theirs = np.flatnonzero(labels[0] == label), labels[1] == label
        for at in range(0, len(mine), 64):
            some = mine[at:at + 64]
            other = theirs[None, :] & (ids[0][some, None] != ids[1][None, :])

            def keep(upper, lower, alive, cols):
                if upper is None:
                    return other
                return upper >= _kth_largest(np.where(alive, lower, -np.inf), k)

            i, j, score, exact = bounded(a, b, some, keep)
            order = np.lexsort((ids[1][j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield i[first], j[first], score[first], int(other.sum()), exact


def best_in_bands(a: Block, b: Block, ids: tuple, labels: tuple, bands: list[list[int]], k: int, percent: int):
    """Per anchor and band the k best rows of other labels; yields (anchor, band, row, score, pairs, exact).

    A band is a positive's score: a row lies in it from ``percent`` hundredths of it up to it.
    """
    low = [[-(-percent * p // 100) for p in own] for own in bands]
    least = np.array([min(x, default=0) for x in low], np.float64)
    most = np.array([max((p for p, x in zip(own, lows) if x <= p), default=-1) for own, lows in zip(bands, low)], np.float64)
    for at in range(0, len(a.v), 64):
        some = np.arange(at, min(at + 64, len(a.v)))
        other = labels[0][some, None] != labels[1][None, :]
        floor, top = least[some, None], most[some, None]
        # With one band, rows that surely lie in it push out those that come after k of them.
        single = np.array([len(bands[i]) == 1 for i in some])[:, None]

        def keep(upper, lower, alive, cols):
            if upper is None:
                return other & (top >= floor)
            inside = np.where(alive & single & (lower >= floor) & (upper <= top), lower, -np.inf)
            return (upper >= floor) & (lower <= top) & (upper >= _kth_largest(inside, k))

        i, j, score, exact = bounded(a, b, some, keep)
        order = np.lexsort((ids[1][j], -score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, some)
        end = np.searchsorted(i, some, side="right")
        out_i, out_band, out_at = [], [], []
        for n, own in enumerate(some):
            mine = -score[begin[n]:end[n]]
            for band, lowest in zip(bands[own], low[own]):
                first = int(np.searchsorted(mine, -band))
                last = min(first + k, int(np.searchsorted(mine, -lowest, side="right")))
                for place in range(first, last):
                    out_i.append(own), out_band.append(band), out_at.append(begin[n] + place)
        out_at = np.array(out_at, np.int64)
        yield np.array(out_i, np.int64), np.array(out_band, np.int64), j[out_at], score[out_at], int((other & (top >= floor)).sum()), exact


def prepared(df: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v, mean, deviation): integer vectors of the rows that take part, with their summaries."""
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(fine)
    fits = F.aggregate("x", F.lit(0.0), lambda t, c: t + F.floor(c * s.scale).cast("double") * F.floor(c * s.scale).cast("double")) < MOST_SQUARED
    rows = rows.where(fits).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("x", lambda c: F.floor(c * s.scale)).alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = usual.n if usual else 1

    def work(batches: Iterator[pa.RecordBatch]):
        cut = edges(dim, s.segments)
        for b in batches:
            mean, deviation = summaries(_matrix(b.column("v"), dim).astype(np.float64), cut)
            yield record_batch(vec_id=b.column("vec_id"), label=b.column("label"), v=b.column("v"), mean=_lists(mean), deviation=_lists(deviation))

    return rows.where(F.size("v") == dim).mapInArrow(work, _SUMMED)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _block(t: pa.Table, fan: int) -> tuple[Block, np.ndarray, np.ndarray]:
    n = t.num_rows
    v, mean, deviation = (t.column(c).combine_chunks() for c in ("v", "mean", "deviation"))
    sides = [c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in (v, mean, deviation)]
    return Block(*sides, fan), t.column("vec_id").to_numpy(), t.column("label").to_numpy()


def _cells(anchors: DataFrame, rows: DataFrame, work, s: Settings, n_anchors: int, n_rows: int) -> DataFrame:
    """Each block of anchors with each block of rows; blocks are dealt by hashes and so hold about as many each."""
    a, b = max(1, -(-n_anchors // s.anchors)), max(1, -(-n_rows // s.rows))
    part = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n)).cast("int")
    left = anchors.withColumn("ab", part(a)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    right = rows.withColumn("rb", part(b)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(work, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(df: DataFrame, anchor: Column, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Hard negatives of every row where ``anchor`` (of vec_id) holds, and how many pairs were scored.

    The first frame has (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); the
    second (step, pairs, exact): pairs that were compared and those of them that outlived all bounds.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, another
    length than most have, or a squared length from 2**62 on (their products don't fit 64 bits) take no
    part.  Equal scores come by smaller id.  Rows that are equal in all columns count once; an id that
    comes with several vectors or labels has each of them.  An anchor without positives, or a positive
    without rows in its band, has no rows; so has an empty table.  Other columns are ignored.
    """
    rows = stored(prepared(df, s).dropDuplicates(["vec_id", "label", "v"]), "vectors")
    anchors = stored(rows.where(anchor), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()

    def cell(search, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.split()[0]: pa.array([], pa.int64()) for f in _FOUND.split(", ")})
        out, pairs, exact = [], 0, 0
        for i, band, vec_id, score, seen, scored in search(left, _block(left, s.fan), _block(right, s.fan)):
            no = np.full(len(i), -1)
            out.append(record_batch(anchor_id=i, band=band, vec_id=vec_id, score=score, seen=no, exact=no))
            pairs, exact = pairs + seen, exact + scored
        zero = np.zeros(1, np.int64)  # the last row of a cell says how many pairs it had
        out.append(record_batch(anchor_id=zero, band=zero, vec_id=zero, score=zero, seen=np.full(1, pairs), exact=np.full(1, exact)))
        return pa.Table.from_batches(out)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        def search(_, one, two):
            (a, own, mine), (b, ids, theirs) = one, two
            for i, j, score, seen, exact in best_of_label(a, b, (own, ids), (mine, theirs), s.positives):
                yield own[i], mine[i], ids[j], score, seen, exact

        return cell(search, left, right)

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        def search(t, one, two):
            (a, own, mine), (b, ids, theirs) = one, two
            for i, band, j, score, seen, exact in best_in_bands(a, b, (own, ids), (mine, theirs), t.column("bands").to_pylist(), s.k, s.least_percent):
                yield own[i], band, ids[j], score, seen, exact

        return cell(search, left, right)

    near = stored(_cells(anchors, rows, positives, s, n_anchors, n_rows), "positives")
    # Of an anchor that comes with several labels, each has its own positives.
    first = stored(_first(near.where("seen < 0"), s.positives).select(
        "anchor_id", F.col("band").alias("label"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct(), "first")
    bands = first.groupBy(F.col("anchor_id").alias("vec_id"), "label").agg(F.collect_set("positive_score").alias("bands"))
    asked = stored(anchors.join(bands, ["vec_id", "label"]), "asked")

    found = stored(_cells(asked, rows, negatives, s, n_anchors, n_rows), "negatives")
    best = _first(found.where("seen < 0").select("anchor_id", "band", "vec_id", "score").distinct(), s.k)
    result = first.select("anchor_id", "positive_id", "positive_score").distinct().join(
        best.withColumnRenamed("band", "positive_score"), ["anchor_id", "positive_score"])
    result = result.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    tally = lambda f, step: f.where("seen >= 0").agg(F.sum("seen").alias("pairs"), F.sum("exact").alias("exact")).select(F.lit(step).alias("step"), "pairs", "exact")
    return result, tally(near, "positives").unionByName(tally(found, "negatives"))


ORACLE = """
WITH rows AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 80 * CAST(positive_score AS HUGEINT) <= 100 * CAST(score AS HUGEINT) AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
