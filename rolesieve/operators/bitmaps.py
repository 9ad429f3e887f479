"""Facet counts under any combination of filters, from an index of bitmaps.

The index holds, for every value of every facet, one bitmap of 32,768 positions per bucket of arrival
keys.  A filter is or/and over its bitmaps, so a changed filter reads index rows, never postings, and
every step is an aggregation by (facet, value, bucket): a hot value is as many rows as there are buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: The facet that every row has: which positions exist.
ALL = "*"


def text_facets(columns: Sequence[str]) -> dict[str, Column]:
    """Trimmed text values of columns; blank ones have no value."""
    return {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns}


def index(df: DataFrame, facets: Mapping[str, Column], position: str = "seq") -> DataFrame:
    """(facet, value, bucket, bits) of rows with a unique whole number ``position`` of at least 0.

    A null value is not indexed, except that every row counts for the facet "*".  Dense positions
    make full bitmaps; where they are sparse, an index row may hold few bits.
    """
    pairs = F.array(F.struct(F.lit(ALL).alias("facet"), F.lit("").alias("value")),
                    *[F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value")) for n, v in facets.items()])
    at = F.col(position).cast("long")
    rows = df.where(at >= 0).select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"), F.inline(pairs))
    return rows.where("value IS NOT NULL").groupBy("facet", "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merged(*indexes: DataFrame) -> DataFrame:
    """One index of several, whose positions may overlap."""
    out = indexes[0]
    for other in indexes[1:]:
        out = out.unionByName(other)
    return out.groupBy("facet", "value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _chosen(idx: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(facet, bucket, bits) of each filtered facet: rows with any of its chosen values."""
    wanted = F.lit(False)
    for facet, values in chosen.items():
        wanted = wanted | ((F.col("facet") == facet) & F.col("value").isin(*values))
    return idx.where(wanted).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def visible(idx: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(bucket, bits) of the rows that have one of the chosen values in every facet of ``chosen``.

    No facets choose all rows; a facet without values chooses none.
    """
    if not chosen:
        return idx.where(F.col("facet") == ALL).select("bucket", "bits")
    both = _chosen(idx, chosen).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return both.where(F.col("_n") == len(chosen)).select("bucket", "bits")


def visible_count(idx: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row (visible, total)."""
    shown = visible(idx, chosen).select(F.bitmap_count("bits").alias("visible"), F.lit(0).cast("long").alias("total"))
    rows = idx.where(F.col("facet") == ALL).select(F.lit(0).cast("long").alias("visible"), F.bitmap_count("bits").alias("total"))
    return shown.unionByName(rows).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("visible", "total")])


def counts(idx: DataFrame, chosen: Mapping[str, Sequence[str]], own: bool = False) -> DataFrame:
    """(facet, value, n): rows of each value under the filter; values without any have their line at 0.

    With ``own``, the filter of a value's own facet counts too; without, a filtered facet shows what
    choosing another of its values would give, as selection lists do.
    """
    lines = idx.where(F.col("facet") != ALL)
    free = visible(idx, chosen).withColumn("_for", F.lit(None).cast("string"))
    if chosen and not own:
        for facet in chosen:
            others = visible(idx, {f: v for f, v in chosen.items() if f != facet})
            free = free.unionByName(others.withColumn("_for", F.lit(facet)))
        mine = F.when(F.col("facet").isin(*chosen), F.col("facet"))
    else:
        mine = F.lit(None).cast("string")
    # Two bitmaps a (facet, value, bucket): the value's and the filter's.
    filters_ = free.withColumnsRenamed({"bits": "_bits", "bucket": "_bucket"})
    met = lines.withColumn("_mine", mine).join(filters_, (F.col("bucket") == F.col("_bucket")) & F.col("_mine").eqNullSafe(F.col("_for")), "left")
    pair = F.array(F.struct(F.col("bits").alias("bits")), F.struct(F.col("_bits").alias("bits")))
    hit = met.where("_bits IS NOT NULL").select("facet", "value", "bucket", F.inline(pair))
    common = hit.groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits")).select("facet", "value", F.bitmap_count("bits").alias("n"))
    none = lines.select("facet", "value", F.lit(0).cast("long").alias("n"))
    return common.unionByName(none).groupBy("facet", "value").agg(F.sum("n").alias("n"))
