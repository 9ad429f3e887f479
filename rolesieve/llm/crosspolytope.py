"""Nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import record_batch, stored


@dataclass(frozen=True)
class Settings:
    """``tables`` tables; a bucket is the signed axes of as many rotations as give about ``per_bucket`` rows.

    The probes a query makes are set so that ``sample`` queries, compared with all rows in blocks,
    find the share ``recall`` of their neighbours.  A bucket of more than ``block`` rows or
    ``query_block`` queries is searched in blocks of that size.
    """

    k: int = 5
    tables: int = 3
    per_bucket: int = 1000
    recall: float = 0.97
    sample: int = 100
    most_probes: int = 4096
    block: int = 4096
    query_block: int = 1024
    seed: int = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """Rotations by three rounds of random signs and a Hadamard transform each."""

    def __init__(self, dim: int, tables: int, parts: int, seed: int):
        self.dim, self.tables, self.parts = dim, tables, parts
        self.wide = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, parts, 3, self.wide))

    def rotated(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.wide))
        y[:, :self.dim] = x
        for signs in self.signs[table, part]:
            y = _hadamard(y * signs)
        return y

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the nearest signed axis of each rotation, combined."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t, p in itertools.product(range(self.tables), range(self.parts)):
            y = self.rotated(x, t, p)
            axis = np.abs(y).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * self.wide) + 2 * axis + (y[np.arange(len(x)), axis] < 0)
        return out

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """(rows, tables, probes): buckets from the likeliest on, at most ``most`` or all there are."""
        sides = 2 * self.wide
        n = min(most, sides ** self.parts)
        out = np.empty((len(x), self.tables, n), np.int64)
        for t in range(self.tables):
            cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for p in range(self.parts):
                y = self.rotated(x, t, p)
                signed = np.stack([y, -y], axis=2).reshape(len(x), sides)
                own = (signed.max(axis=1, keepdims=True) - signed) ** 2
                cost = (cost[:, :, None] + own[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * sides + np.arange(sides)).reshape(len(x), -1)
                keep = np.argsort(cost, axis=1, kind="stable")[:, :n]
                cost, code = np.take_along_axis(cost, keep, 1), np.take_along_axis(code, keep, 1)
            out[:, t] = code
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of vectors that take part, and their length.

    Null and zero vectors, null or non-finite components and null ids take no part, nor do vectors of
    another length than most have.
    """
    v = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most.n if most else 1
    return v.where(F.size("v") == dim), dim


def _best(q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, k: int):
    """(query, vector, score) of the k nearest vectors of each query and those as near as the last."""
    a, b = _unit(q), _unit(v)
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(a), 256):
        near = a[at:at + 256] @ b.T
        n = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n, None] - 1e-9
        i, j = np.nonzero(near >= least)
        s = cosines(q[at + i], v[j])
        order = np.lexsort((vid[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (nth < k) | (s == s[np.searchsorted(i, i) + np.minimum(k, np.bincount(i)[i]) - 1])  # and whoever ties with the last
        out_q.append(qid[at + i[keep]]), out_v.append(vid[j[keep]]), out_s.append(s[keep])
    return record_batch(query=np.concatenate(out_q), vector=np.concatenate(out_v), score=np.concatenate(out_s))


def _in_blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], dim: int, k: int) -> DataFrame:
    """The nearest of each block's vectors to each of its queries; blocks are bounded."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "vector": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        made = _best(*(_matrix(t.column("v").combine_chunks(), dim) for t in (left, right)), *(t.column("node").to_numpy() for t in (left, right)), k)
        return pa.Table.from_batches([made])

    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(work, "query long, vector long, score double")


def _spread(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _search(queries: DataFrame, vectors: DataFrame, dim: int, k: int, s: Settings) -> DataFrame:
    """Queries and vectors (bucket, node, v) that share a bucket, in blocks; hot buckets have many."""
    sizes = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    sizes = stored(sizes.join(asked, "bucket").select("bucket", _spread(F.col("n"), s.block).alias("n"), _spread(F.col("m"), s.query_block).alias("m")), "bucket-sizes")
    part = lambda count: F.pmod(F.xxhash64("node", F.lit(1)), F.col(count)).cast("int")
    vectors = vectors.join(sizes, "bucket").select("bucket", part("n").alias("vb"), F.explode(F.expr("sequence(0, m - 1)")).alias("qb"), "node", "v")
    queries = queries.join(sizes, "bucket").select("bucket", F.explode(F.expr("sequence(0, n - 1)")).alias("vb"), part("m").alias("qb"), "node", "v")
    return _in_blocks(queries, vectors, ["bucket", "vb", "qb"], dim, k)


def _everywhere(queries: DataFrame, vectors: DataFrame, dim: int, k: int, s: Settings) -> DataFrame:
    """Every query against all vectors, in blocks."""
    n = max(1, -(-vectors.count() // s.block))
    m = max(1, -(-queries.count() // s.query_block))
    part = lambda count: F.pmod(F.xxhash64("node", F.lit(1)), F.lit(count)).cast("int")
    v = vectors.select(part(n).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb"), "node", "v")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("vb"), part(m).alias("qb"), "node", "v")
    return _in_blocks(q, v, ["vb", "qb"], dim, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vector")
    return found.groupBy("query", "vector").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _calibrated(classes: DataFrame, asked: DataFrame, n: int, dim: int, s: Settings) -> tuple[Hasher, int]:
    """A hasher and the probes with which sample queries find their neighbours."""
    some = stored(asked.orderBy(F.xxhash64("node"), "node").limit(s.sample), "sample")
    near = _top(_everywhere(some, classes, dim, s.k + 1, s), s.k + 1).where("query <> vector")
    near = near.join(some.select(F.col("node").alias("query"), F.col("v").alias("qv")), "query")
    near = near.join(classes.select(F.col("node").alias("vector"), "v"), "vector").select("qv", "v").toArrow()  # at most sample * k rows
    parts = max(1, round(np.log(max(n, 1) / s.per_bucket) / np.log(2 * Hasher(dim, 1, 1, 0).wide)))
    if not near.num_rows:
        return Hasher(dim, s.tables, 1, s.seed), 1
    q, v = (_matrix(near.column(c).combine_chunks(), dim) for c in ("qv", "v"))
    while True:
        hasher = Hasher(dim, s.tables, parts, s.seed)
        tried = hasher.probes(q, s.most_probes)
        hits = tried == hasher.buckets(v)[:, :, None]
        rank = np.where(hits.any(axis=2), hits.argmax(axis=2), tried.shape[2]).min(axis=1)
        need = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(s.recall * len(rank))) - 1)]) + 1
        if need <= tried.shape[2]:
            return hasher, need
        parts -= 1  # with one rotation, all buckets can be tried


def nearest(df: DataFrame, query: Column, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row where ``query`` holds.

    df has vec_id and embedding.  Equal vectors are one class with its k + 1 smallest ids, which is all
    that a result can need; classes are hashed and searched, scores taken from the vectors as they are.
    A query that finds fewer than k rows is compared with all.  Ties go to the smaller vec_id.

    Vectors that usable() leaves out take no part.  Repeated rows of one id and vector are one row.  An
    empty table gives no rows; other columns are ignored.
    """
    vectors, dim = usable(df)
    vectors = stored(vectors.withColumn("h", F.xxhash64("v")).withColumn("g", F.hash("v", F.lit(3))).dropDuplicates(["vec_id", "h", "g"]), "vectors")
    first = Window.partitionBy("h", "g").orderBy("vec_id")
    ranked = vectors.select("h", "g", "vec_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= s.k + 1)
    members = stored(ranked.groupBy("h", "g").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    # The class of an id: a repeated id may have several vectors, so the hash tells which is meant.
    named = members.select("h", "g", "node", "ids")
    classes = stored(vectors.join(named.select("h", "g", F.col("node").alias("vec_id")), ["h", "g", "vec_id"]).select(F.xxhash64("h", "g").alias("node"), "v", "vec_id"), "nodes")
    asked_rows = stored(vectors.where(query).select(F.col("vec_id").alias("query_id"), F.xxhash64("h", "g").alias("query")).distinct(), "queries")
    asked = stored(classes.select("node", "v").join(asked_rows.select(F.col("query").alias("node")).distinct(), "node", "left_semi"), "asked")
    n = classes.count()
    hasher, probes = _calibrated(classes.select("node", "v"), asked, n, dim, s)

    def index(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            for t, own in enumerate(hasher.buckets(x).T):
                yield record_batch(bucket=own * hasher.tables + t, node=b.column("node"), v=b.column("v"))

    def probe(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for t, own in enumerate(hasher.probes(_matrix(part.column("v"), dim), probes).transpose(1, 0, 2)):
                    rows = pa.array(np.repeat(np.arange(part.num_rows), own.shape[1]))
                    yield record_batch(bucket=own.ravel() * hasher.tables + t, node=part.column("node").take(rows), v=part.column("v").take(rows))

    kind = "bucket long, node long, v array<double>"
    indexed = classes.select("node", "v").mapInArrow(index, kind)
    probed = asked.mapInArrow(probe, kind)
    found = stored(_search(probed, indexed, dim, s.k + 1, s), "found")
    result = _rows(found, members, asked_rows, s)
    result = stored(result, "neighbours")
    got = result.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"))
    short = asked_rows.join(got, ["query_id", "query"], "left").where(F.coalesce("n", F.lit(0)) < s.k)
    short = stored(short.select("query_id", "query"), "short")
    if not short.isEmpty():
        left = asked.join(short.select(F.col("query").alias("node")).distinct(), "node", "left_semi")
        more = _rows(_everywhere(left, classes.select("node", "v"), dim, s.k + 1, s), members, short, s)
        result = result.join(short, ["query_id", "query"], "left_anti").select(*more.columns).unionByName(more)
    return result.select("query_id", "rank", "vec_id", "score")


def _rows(found: DataFrame, members: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """From classes to rows: the k nearest ids of each query, its own left out."""
    ids = members.select(F.xxhash64("h", "g").alias("vector"), "node", "ids")
    best = found.groupBy("query", "vector").agg(F.max("score").alias("score")).join(ids, "vector")
    nth = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = best.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= s.k + 1)
    rows = asked.join(best.drop("node"), "query").select("query_id", "query", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= s.k).select("query_id", "query", "rank", "vec_id", "score")
