"""From raw landed postings to the new, valid, wanted ones, with a funnel of what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Config
from ..functions.text import optional_string
from ..functions.titles import is_listed_company, is_wanted_title
from ..functions.urls import canonical_url
from ..operators import dedupe
from ..operators.ranking import output_order, top_n as take_top
from ..operators.validate import has_title, is_http_url, normalise
from ..sources.postings import union_by_name

KEPT = "kept"


def _with_job_url(raw: DataFrame) -> DataFrame:
    """``job_url`` from whichever of its two names the frame has."""
    if "url" not in raw.columns:
        return raw
    names = [c for c in ("job_url", "url") if c in raw.columns]
    return raw.withColumn("job_url", F.coalesce(*[optional_string(F.col(c)) for c in names])).drop("url")


def _title(raw: DataFrame) -> Column:
    return F.col("title") if "title" in raw.columns else F.lit(None).cast("string")


def ingest_keys(raw: DataFrame, cfg: Config = DEFAULT, seq: str = "seq") -> DataFrame:
    """(seq, job_url, fingerprint as two hashes, has_title, wanted): all that decides about a posting, without its texts."""
    raw = _with_job_url(raw)
    return dedupe.posting_keys(raw, seq, carry={
        "has_title": has_title(_title(raw)),
        "wanted": is_wanted_title(_title(raw), cfg),
    })


def decide_keys(keys: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(seq, url_key, stage, n_rows) from ingest_keys() and the URLs among them that were kept before.

    The hits meet the URLs where these are grouped already; from there on a number stands for the stage.
    """
    urls = dedupe.first_per_url(keys)
    is_seen = F.lit(False)
    if hits is not None:
        urls = urls.join(hits.withColumn("_seen", F.lit(True)), "job_url", "left")
        is_seen = F.coalesce("_seen", F.lit(False))
    code = (
        F.when(is_seen, 0)
        .when(~F.col("has_title") | ~is_http_url(F.col("job_url")), 1)
        .when(~F.col("wanted"), 2)
        .otherwise(3)
    )
    out = dedupe.first_per_fingerprint(urls.select("seq", "job_url", "print_a", "print_b", code.alias("code"), "n_rows"))
    names = F.array(*[F.lit(name) for name in ("seen", "invalid", "unwanted title", KEPT)])
    return out.select("seq", "url_key", F.element_at(names, F.col("code") + 1).alias("stage"), "n_rows")


def decide(raw: DataFrame, seen: DataFrame | None = None, cfg: Config = DEFAULT, include_seen: bool = False,
           seq: str = "seq", urls: bool = True) -> DataFrame:
    """(seq, url_key, stage, n_rows, job_url): one row per deduplicated posting and where it ended.

    stage is seen, invalid, unwanted title or kept; n_rows counts the fetched rows behind it.
    Only keys and flags are shuffled.  ``seq`` must be unique; see sources.postings.with_arrival_key.
    Without ``urls`` the column job_url, fetched by a join, is left out; nothing else here needs it.
    """
    keys, hits = ingest_keys(raw, cfg, seq), None
    if seen is not None and not include_seen:
        # From the batch's side first: a small batch can be broadcast, and only the ledger's hits move.
        batch = _with_job_url(raw).select(canonical_url(F.col("job_url")).alias("job_url"))
        hits = seen.select("job_url").join(batch, "job_url", "left_semi").distinct()
    out = decide_keys(keys, hits)
    if not urls:
        return out
    return out.join(keys.select("seq", "job_url", dedupe.url_key(F.col("job_url")).alias("url_key")), ["seq", "url_key"])


def rows_of(raw: DataFrame, decisions: DataFrame, cfg: Config = DEFAULT, seq: str = "seq") -> DataFrame:
    """The kept postings in the fixed schema, listed companies flagged.

    Unwanted titles are dropped before the join, so the wide rows that move are near the final ones.
    The URL's key is part of the join, so an arrival key that was not unique cannot pair a row with another's URL.
    """
    raw = _with_job_url(raw)
    kept = decisions.where(F.col("stage") == KEPT).select(F.col("seq").alias("_seq"), F.col("url_key").alias("_url_key"))
    wanted = raw.where(is_wanted_title(_title(raw), cfg)).withColumn("job_url", canonical_url(F.col("job_url")))
    wide = wanted.join(kept, (F.col(seq) == F.col("_seq")) & (dedupe.url_key(F.col("job_url")) == F.col("_url_key")), "left_semi")
    passed = [c for c in (seq, "batch_id") if c in wide.columns]
    listed = is_listed_company(F.col("company"), cfg.fortune_500_companies)
    return normalise(wide, keep=tuple(passed), canonical=True).withColumn("is_fortune_500", listed)


def ingest(raw: DataFrame, seen: DataFrame | None = None, cfg: Config = DEFAULT, top_n: int = 0,
           append: bool = False, include_seen: bool = False, seq: str = "seq",
           decisions: DataFrame | None = None) -> DataFrame:
    """New postings: deduplicated, not seen before, valid, wanted; sorted unless appending.

    Give ``decisions`` (from decide(), persisted) when the funnel is wanted too.
    """
    if decisions is None:
        decisions = decide(raw, seen, cfg, include_seen, seq, urls=False)
    rows = rows_of(raw, decisions, cfg, seq)
    return rows if append else take_top(rows, output_order(), top_n)


def funnel(decisions: DataFrame, queries_run: int = 0, top_n: int = 0) -> DataFrame:
    """One row of counts per stage and a readable diagnosis."""
    kept = F.count_if(F.col("stage") == KEPT)
    final = F.least(kept, F.lit(top_n)) if top_n > 0 else kept
    counts = decisions.agg(
        F.lit(queries_run).cast("long").alias("queries_run"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("fetched"),
        F.count(F.lit(1)).alias("deduped"),
        F.count_if(F.col("stage") == "seen").alias("seen_skipped"),
        F.count_if(F.col("stage") == "invalid").alias("invalid_skipped"),
        F.count_if(F.col("stage") == "unwanted title").alias("title_filtered"),
        final.cast("long").alias("final_count"),
    )
    diagnosis = (
        F.when(F.col("final_count") > 0, "jobs kept")
        .when(F.col("fetched") == 0, "no jobs returned from any source")
        .when(F.col("seen_skipped") == F.col("deduped"), "all fetched jobs were already tracked")
        .otherwise("no jobs left after filtering")
    )
    return counts.withColumn("diagnosis", diagnosis)


def collect_query(sites: list[DataFrame], seq: str = "seq") -> DataFrame:
    """Rows of one search over several boards: union by name, first per URL as fetched."""
    return dedupe.dedupe_by_raw_url(union_by_name(sites), seq)
