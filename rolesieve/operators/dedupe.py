"""Keep the first posting per canonical URL, then per company/title/location fingerprint.

Both steps are hash aggregations, not windows: the lowest arrival key and what belongs to it, all of
fixed width, collapse the copies of a hot key on the map side, so a URL or fingerprint that holds a
third of all rows reaches its reducer as one row per map task.  Only keys travel through them; the
wide rows move once, joined back on the unique arrival key, which is spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import matching_form
from ..functions.urls import canonical_url


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    return F.concat_ws("|", matching_form(company), matching_form(title), matching_form(location))


def is_known_company(company: Column, null_is_known: bool = True) -> Column:
    """A null company counts as known unless told otherwise; the word "unknown" never does."""
    return F.coalesce(F.lower(company) != "unknown", F.lit(null_is_known))


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """First row per key by the order columns; rows equal in these are ranked by all columns.

    For frames without a unique arrival key.  Columns must be orderable (no maps).
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select(
        *[F.col(f"_first.`{c}`") for c in df.columns]
    )


def _prints(text: Column, comparable: Column) -> list[Column]:
    """128 bits of a fingerprint, so that it is carried in fixed width; null where nothing is comparable."""
    return [F.when(comparable, F.xxhash64(text)).alias("print_a"), F.when(comparable, F.xxhash64(F.lit("second"), text)).alias("print_b")]


def posting_keys(df: DataFrame, seq: str = "seq", carry: dict[str, Column] | None = None,
                 null_company_is_known: bool = True) -> DataFrame:
    """Narrow key table: arrival key, canonical URL, fingerprint (two hashes) or nulls when not comparable.

    Without a title or company column nothing is comparable.  What is carried should be of fixed width.
    """
    title, company, location = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("title", "company", "location"))
    print_ = fingerprint(title, company, location)
    comparable = is_known_company(company, null_company_is_known) & (F.length(print_) > 2)
    if not {"title", "company"} <= set(df.columns):
        comparable = F.lit(False)
    return df.select(
        F.col(seq).alias("seq"),
        canonical_url(F.col("job_url")).alias("job_url"),
        *_prints(print_, comparable),
        *[value.alias(name) for name, value in (carry or {}).items()],
    )


def url_key(job_url: Column) -> Column:
    """What a winner is joined back with besides ``seq``, so that a key that was not unique pairs no row with another's URL."""
    return F.xxhash64(job_url)


def _of_first(columns: list[str]) -> list[Column]:
    return [F.min_by(c, "seq").alias(c) for c in columns]


def first_per_url(keys: DataFrame) -> DataFrame:
    """First key row per URL; ``n_rows`` counts the rows it stands for.

    The state of a group is numbers and flags only, so both aggregations are hashed, not sorted.
    """
    rest = [c for c in keys.columns if c not in ("seq", "job_url")]
    return keys.groupBy("job_url").agg(*_of_first(rest), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_rows")).select(
        "seq", "job_url", *rest, "n_rows")


def first_per_fingerprint(keys: DataFrame) -> DataFrame:
    """First key row per fingerprint, its URL as ``url_key``; rows without one each form a group of their own."""
    rest = [c for c in keys.columns if c not in ("seq", "job_url", "print_a", "print_b", "n_rows")]
    alone = F.when(F.col("print_a").isNull(), F.col("seq"))
    return (
        keys.withColumn("url_key", url_key(F.col("job_url"))).groupBy("print_a", "print_b", alone.alias("_alone"))
        .agg(*_of_first(["url_key", *rest]), F.min("seq").alias("seq"), F.sum("n_rows").alias("n_rows"))
        .select("seq", "url_key", *rest, "n_rows")
    )


def _rows_of(df: DataFrame, winners: DataFrame, seq: str, url: Column) -> DataFrame:
    """The winners' rows with ``url`` as their job_url; texts and URLs are fetched for these only."""
    key = "url_key" if "url_key" in winners.columns else "job_url"
    chosen = winners.select(F.col("seq").alias("_seq"), (F.col(key) if key == "url_key" else url_key(F.col(key))).alias("_url_key"))
    on = (F.col(seq) == F.col("_seq")) & (url_key(url) == F.col("_url_key"))
    return df.join(chosen, on, "left_semi").withColumn("job_url", url)


def dedupe_by_url(df: DataFrame, seq: str = "seq") -> DataFrame:
    """First row per canonical URL, the URL made canonical; ``seq`` must be unique."""
    url = canonical_url(F.col("job_url"))
    return _rows_of(df, first_per_url(df.select(F.col(seq).alias("seq"), url.alias("job_url"))), seq, url)


def dedupe_by_raw_url(df: DataFrame, seq: str = "seq") -> DataFrame:
    """First row per URL as fetched; null URLs count as one."""
    return _rows_of(df, first_per_url(df.select(F.col(seq).alias("seq"), "job_url")), seq, F.col("job_url"))


def dedupe(df: DataFrame, seq: str = "seq", null_company_is_known: bool = True) -> DataFrame:
    """By URL, then by fingerprint among the first step's survivors; ``seq`` must be unique."""
    keys = posting_keys(df, seq, null_company_is_known=null_company_is_known)
    return _rows_of(df, first_per_fingerprint(first_per_url(keys)), seq, canonical_url(F.col("job_url")))
