"""A bounded sample of labelled documents for training a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document's checksum keeps its label out of training; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: dict[int, int], max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class[label]`` documents a class and ``max_bytes`` bytes each.

    The documents are those with the smallest hashes of their ids among the texts that are not longer,
    whatever the table's order.  A document with both labels counts with the larger.
    """
    known = labels.where(F.col(label).isin(*per_class) & F.col("doc_id").isNotNull() & ~fold)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # Ids of texts that are short enough meet the labels first; only the chosen ones' texts are fetched.
    fitting = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for y, n in per_class.items():
        some = fitting.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    # The chosen ids are at most the sample's size, a parameter.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    picked = sorted(rows.select("y", F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect(), key=lambda r: (r.h, r.doc_id))
    return [(r.text, y) for y in per_class for r in picked if r.y == y]
