"""Near-duplicate documents by min-max hashing: both ends of each permutation make the signature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Texts, mixed, shingles, stored, text_slices
from .components import components


@dataclass(frozen=True)
class Settings:
    """A link needs ``100 * intersection >= percent * union`` of the sets of ``words``-word shingles.

    ``permutations`` hash evaluations give twice as many signature values.  With 16 bands of 4, a
    pair of similarity 0.85 shares no band with probability 7e-6.  ``slack`` standard deviations
    below the threshold, a signature rules a pair out before its sets are compared.
    """

    words: int = 5
    percent: int = 85
    permutations: int = 32
    rows: int = 4
    slack: float = 6.0
    seed: int = 7


def _coefficients(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    a = rng.integers(1, 1 << 63, s.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, s.permutations, dtype=np.uint64)[:, None]


def shingle_sets(texts: Texts, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than that make one shingle."""
    found = texts.words(lower=True)
    hashes = found.hashes()
    runs, counts = shingles(hashes, found.first, words)
    for i, n in enumerate(counts):
        first, last = found.first[i], found.first[i + 1]
        if n:
            yield np.unique(runs[first:first + n])
        elif last > first:  # all words as one, told apart from runs of full length
            few, _ = shingles(hashes[first:last], np.array([0, last - first]), last - first)
            yield mixed(few[:1] + np.uint64(last - first))
        else:
            yield np.empty(0, np.uint64)


def _set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one = int(mixed(found).sum(dtype=np.uint64)) if len(found) else 0
    two = int(mixed(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) if len(found) else 0
    return one, two


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, alternating, as 32-bit values."""
    values = ((found[None, :] * a + b) >> np.uint64(32)).astype(np.uint32)
    return np.stack([values.min(axis=1), values.max(axis=1)], axis=1).ravel().view(np.int32)


def signatures(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, node, check, signature) of every row; node and check name its set.

    Without words, the set is empty and the signature null.
    """
    wide = 2 * s.permutations

    def work(batches):
        a, b = _coefficients(s)
        for part, texts in text_slices(batches):
            n, node, check, rows = [], [], [], []
            for found in shingle_sets(texts, s.words):
                one, two = _set_key(found)
                n.append(len(found)), node.append(one), check.append(two)
                rows.append(signature(found, a, b) if len(found) else None)
            values = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int32)])
            offsets = np.concatenate([[0], np.cumsum([0 if r is None else wide for r in rows])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([r is None for r in rows]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)),
                 pa.array(np.array(check, np.uint64).view(np.int64)), listed],
                names=["doc_id", "n_shingles", "node", "check", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, n_shingles long, node long, check long, signature array<int>")


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(node, shingles) of the documents: the sorted 64-bit hashes as bytes."""

    def work(batches):
        for part, texts in text_slices(batches):
            node, sets = [], []
            for found in shingle_sets(texts, s.words):
                node.append(_set_key(found)[0]), sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sets, pa.binary())],
                                             names=["node", "shingles"])

    return docs.select("text").mapInArrow(work, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The links among pairs (a, b) of nodes, by their full sets."""

    def work(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            last, one = None, None
            x, y = batch.column("x"), batch.column("y")
            a = batch.column("a").to_numpy()
            for i in range(batch.num_rows):
                if a[i] != last or one is None:
                    last, one = a[i], np.frombuffer(x[i].as_py(), np.uint64)
                two = np.frombuffer(y[i].as_py(), np.uint64)
                if 100 * min(len(one), len(two)) < s.percent * max(len(one), len(two)):
                    continue
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= s.percent * (len(one) + len(two) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    full = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    )
    return full.mapInArrow(work, "a long, b long").distinct()


def _possible(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Pairs that sizes and signatures do not rule out."""
    values, p = 2 * s.permutations, s.percent / 100
    least = values * p - s.slack * (values * p * (1 - p)) ** 0.5
    one = reps.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    two = reps.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb")).where(same >= least).select("a", "b")
    )


def _across(sets: DataFrame, torn: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of torn (node, component, apart) that may be linked across components, one of them apart.

    Under one order of all shingles, rarest first, the first shingle that a linked pair shares lies
    early in both sets, and as many must follow it in both as they share.  A text with many shingles
    of its own has none to share early, so it meets nobody, however large its bucket.
    """
    own = stored(sets.join(torn, "node"), "torn-sets")

    def explode(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
            sizes = np.array([len(x) for x in found], np.int64)
            for at in range(0, len(found), 256):
                n = sizes[at:at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("node").to_numpy()[at:at + 256], n)), pa.array(np.repeat(n, n)),
                     pa.array(np.concatenate(found[at:at + 256]))], names=["node", "size", "shingle"])

    rows = own.mapInArrow(explode, "node long, size long, shingle long")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = Window.partitionBy("node").orderBy("f", "shingle")
    ranked = (
        rows.join(stored(shared, "shared"), "shingle")
        .withColumn("among", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node")))
        .withColumn("at", F.col("size") - F.col("n") + F.col("among") - 1)
        .where(100 * (F.col("size") - F.col("at")) >= s.percent * F.col("size"))
    )
    early = stored(ranked.select("node", "size", "shingle", "at").join(torn, "node"), "early-shingles")
    one = early.where("apart").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "at", "component")))
    two = early.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "at", "component", "apart")))
    follow = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    may = ((F.col("component_a") != F.col("component_b")) & (~F.col("apart_b") | (F.col("node_a") < F.col("node_b")))
           & ((100 + s.percent) * follow >= s.percent * (F.col("size_a") + F.col("size_b"))))
    return one.join(two, (one.shingle == two.shingle) & may).select(
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text, ...).

    Equal sets become one node first.  In each band's bucket all nodes are compared with one of
    them, its center.  Where a bucket then holds several components, the nodes apart from that one's meet
    the others by the rarest shingles they share, which leaves out no link and never pairs a whole
    bucket.  Links are confirmed on full sets.

    Null and empty texts, and texts of spaces only, have no shingles and link with nothing: each
    is its own component.  Repeated rows are equal sets.  Rows with a null doc_id are kept, with a
    null component.  Rows that share a doc_id are one document.  An empty table gives no rows; other
    columns are ignored.
    """
    sigs = stored(signatures(docs, s), "signatures")
    # No id, no links; rows of one id with different texts are tied together by that id.
    named = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(
        named.groupBy("node", "check", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "nodes")
    bands = 2 * s.permutations // s.rows
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("signature", i * s.rows + 1, s.rows)) for i in range(bands)))
    members = reps.select("node", F.explode(keys).alias("bucket"))
    sizes = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    members = stored(members.join(sizes, "bucket"), "members")
    # The center is the node with the most company in all its buckets: one that few edits set apart.
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = stored(members.join(weights, "node"), "weighed")
    buckets = weighed.groupBy("bucket").agg(F.max(F.col("weight")).alias("weight")).join(weighed, ["bucket", "weight"])
    buckets = stored(buckets.groupBy("bucket", "n").agg(F.min("node").alias("center")), "buckets")
    members = stored(members.drop("n").join(buckets.select("bucket", "center"), "bucket"), "members")
    pairs = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_possible(pairs, reps, s), "pairs")
    # The sets of all nodes that share a bucket; only their texts are read again.
    ids = reps.join(members.select("node").distinct(), "node", "left_semi").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id", "left_semi")
    sets = stored(_sets(texts, s), "shingle-sets")
    links = stored(_confirmed(pairs, sets, s), "links")

    known = components(links)
    placed = members.join(known, "node", "left").select("bucket", "center", "node", F.coalesce("component", "node").alias("component"))
    heads = known.select(F.col("node").alias("center"), F.col("component").alias("head"))
    placed = stored(placed.join(heads, "center", "left").withColumn("head", F.coalesce("head", "center")), "placed")
    # A bucket of two is done: its pair has been compared.
    of_more = placed.join(buckets.where("n > 2").select("bucket"), "bucket", "left_semi")
    apart = of_more.where("component <> head")
    beside = of_more.join(apart.select("bucket").distinct(), "bucket", "left_semi").where("node <> center")
    torn = stored(beside.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("head")).alias("apart")), "torn")
    more = stored(_possible(_across(sets, torn, s), reps, s), "pairs")
    if not more.isEmpty():
        links = stored(links.unionByName(_confirmed(more, sets, s)), "links")
        known = components(links)

    # From nodes to documents: the smallest id of a component, over all rows of its nodes.
    of = reps.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(known, "node", "left")
    of = stored(of.withColumn("component", F.coalesce("component", "node")), "classes")
    firsts = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = stored(of.join(stored(firsts, "firsts"), "component").select("node", "component_id"), "classes")
    keyed = sigs.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    out = _one_per_id(keyed.where("node IS NOT NULL").join(classes, "node").select("doc_id", "n_shingles", "component_id"))
    rest = keyed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Rows as they are, but where one id has sets of several components, all of these become one."""
    rows = stored(rows, "classed")
    torn = rows.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    torn = stored(torn.select("a", "b"), "torn")
    if torn.isEmpty():
        return rows
    joined = components(torn).select(F.col("node").alias("component_id"), F.col("component").alias("joined"))
    return rows.join(joined, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("joined", "component_id").alias("component_id"))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of documents that are kept: all columns, one document of each component.

    A document that comes several times stays once; ties of different rows under one id go to the
    smallest text.  Rows without shingles or without an id stay.
    """
    found = near_duplicates(docs, s)
    kept = found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    empty = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    bare = docs.where(empty | F.col("doc_id").isNull())
    chosen = docs.where(~empty & F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    return chosen.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(docs.columns).unionByName(bare)
