"""Quality rules on whole texts: word and line statistics, and bands of n-gram perplexity per language.

The n-grams are runs of ``order`` bytes of the lower-cased text.  They are counted over all documents,
made into one interpolated modified Kneser-Ney model per language by joins and sums, and looked up in
sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, Texts, record_batch, shingles, stored, text_slices


@dataclass(frozen=True)
class Settings:
    """Bands are the median of a language's log perplexities -/+ so many robust deviations.

    A deviation is at least ``least_deviation``, and grows for short texts by ``per_root`` over the
    root of their bytes.  Models of up to ``broadcast_rows`` n-grams are sent to the tasks as sorted
    arrays (20 bytes an n-gram); larger ones stay tables and are joined.
    """

    order: int = 5
    below: float = 5.0
    above: float = 4.0
    least_deviation: float = 0.02
    per_root: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30
    broadcast_rows: int = 8_000_000


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = _LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(texts: Texts, order: int) -> np.ndarray:
    """At each byte, the run of ``order`` folded bytes that ends there; zeros lie before each text."""
    data = _FOLD[texts.data].astype(np.uint64)
    out = data.copy()
    n = len(data)
    for k in range(1, order):
        out[k:] |= data[: n - k] << np.uint64(8 * k)
    starts = texts.offsets[:-1]
    for k in range(order - 1):  # the k-th byte of a text has k before it
        at = starts[(texts.offsets[1:] - starts) > k] + k
        out[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return out.astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); tasks add up before anything is sent."""

    def work(batches):
        held: dict[str, list] = {}
        for part, texts in text_slices(batches):
            codes = grams(texts, order)
            sizes = np.diff(texts.offsets)
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                new = np.unique(codes[np.repeat(langs == lang, sizes)], return_counts=True)
                if not len(new[0]):
                    continue
                pending = held.setdefault(lang, [])
                pending.append(new)
                if len(pending) > 16:
                    held[lang] = [_summed(*(np.concatenate(x) for x in zip(*pending)))]
        for lang, pending in held.items():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*pending)))
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield record_batch(lang=pa.array([lang] * len(keys[part]), pa.string()), gram=keys[part], n=counts[part])

    return docs.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, p, backoff) of all n-grams of 1 to ``order`` bytes.

    p is the interpolated probability of the last byte after the others; backoff is the share a
    context leaves to shorter ones, for n-grams that are contexts.  Below the highest order, counts
    are of different bytes before.  A language's discounts come from its counts of counts; where
    these are too few, a discount is one half.
    """
    levels = {order: stored(counts.select("lang", "gram", F.col("n").alias("c")), "grams")}
    for size in range(order - 1, 0, -1):
        mask = (1 << (8 * size)) - 1
        shorter = levels[size + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels[size] = stored(shorter, "grams")
    lower, parts = None, []
    for size in range(1, order + 1):
        level = levels[size]
        n = level.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        cut = lambda k: F.when(usable, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(0.5)
        # Written, so that its size is known before the join: a row a language, sent rather than all n-grams dealt by language.
        n = stored(n.select("lang", *(cut(k).alias(f"d{k}") for k in (1, 2, 3))), "discounts")
        level = level.join(n, "lang").withColumn("context", F.shiftright("gram", 8))
        level = level.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("left"))
        level = level.select("lang", "gram", "context", F.col("c") - F.col("d")).toDF("lang", "gram", "context", "rest").join(contexts, ["lang", "context"])
        if lower is None:
            level = level.withColumn("below", F.lit(1 / 256))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1))
            level = level.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower = stored(level.select("lang", "gram", "context", "left", (F.col("rest") / F.col("total") + F.col("left") * F.col("below")).alias("p")), "model")
        parts.append((size, lower))
    out = []
    for size, model in parts:
        here = model.select("lang", F.lit(size).alias("size"), "gram", "p")
        if size < order:
            above = parts[size][1].select("lang", F.col("context").alias("gram"), F.col("left").alias("backoff")).distinct()
            here = here.join(above, ["lang", "gram"], "left").select("lang", "size", "gram", "p", F.coalesce("backoff", F.lit(1.0)).alias("backoff"))
        else:
            here = here.withColumn("backoff", F.lit(1.0))
        out.append(here)
    return reduce(DataFrame.unionByName, out)


def arrays(model: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted n-grams with log probability and log backoff, by language and length."""
    rows = model.select("lang", "size", "gram", F.log("p").cast("float").alias("p"), F.log("backoff").cast("float").alias("b")).toArrow()
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    size, gram, p, b = (rows.column(c).to_numpy() for c in ("size", "gram", "p", "b"))
    out = {}
    for lang in set(langs):
        for n in np.unique(size):
            mine = np.flatnonzero((langs == lang) & (size == n))
            mine = mine[np.argsort(gram[mine])]
            out[lang, int(n)] = gram[mine], p[mine], b[mine]
    return out


def log_probabilities(codes: np.ndarray, tables: dict, lang: str, order: int) -> np.ndarray:
    """Log probability of each n-gram; one not seen falls back to shorter ones."""
    keys, p, _ = tables[lang, order]
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    out = p[at].astype(np.float64)
    lost = np.flatnonzero(keys[at] != codes)
    carried = np.zeros(len(lost))
    for size in range(order - 1, 0, -1):
        if not len(lost):
            return out
        keys, p, b = tables[lang, size]
        context = codes[lost] >> 8 & ((1 << (8 * size)) - 1)
        c = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        carried += np.where(keys[c] == context, b[c], 0.0)
        short = codes[lost] & ((1 << (8 * size)) - 1)
        at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        hit = keys[at] == short
        out[lost[hit]] = carried[hit] + p[at[hit]]
        lost, carried = lost[~hit], carried[~hit]
    out[lost] = carried - np.log(256)
    return out


def base_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = texts.words()
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[texts.offsets])
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[words.start] = 1
    inside[words.end] -= 1
    chars = (np.cumsum(inside[:-1]) > 0) & ((texts.data & 0xC0) != 0x80)
    windows, counts = shingles(words.hashes(), words.first, 8)
    repeat = np.zeros(len(texts), np.int64)
    duplicate = np.zeros(len(texts), np.int64)
    lines = per_text(texts.data == 10)
    data = texts.data.tobytes()
    for i in range(len(texts)):
        n = int(counts[i])
        if n > 1:
            mine = windows[words.first[i]:words.first[i] + n]
            ordered = np.sort(mine)
            again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(again):
                hit = np.isin(mine, again)
                cover = np.zeros(n + 8, np.int64)
                cover[:n] += hit
                cover[8:] -= hit
                repeat[i] = int(np.count_nonzero(np.cumsum(cover)[: n + 7] > 0))
        if lines[i]:
            own = [x for x in data[texts.offsets[i]:texts.offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
            duplicate[i] = len(own) - len(set(own))
    return {"n_words": words.counts(), "word_chars": per_text(chars), "n_symbols": per_text(_SYMBOL[texts.data]),
            "n_dup_lines": duplicate, "n_repeat_words": repeat}


_STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _scores(docs: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, lang, the base statistics, n_bytes, log_p): by sorted arrays, or by a join beyond their size."""
    spark = docs.sparkSession
    if model.count() <= s.broadcast_rows:
        sent = spark.sparkContext.broadcast(arrays(model))

        def score(batches: Iterator[pa.RecordBatch]):
            for part, texts in text_slices(batches):
                codes = grams(texts, s.order)
                sizes = np.diff(texts.offsets)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                log_p = np.zeros(len(codes))
                for lang in set(langs):
                    mine = np.repeat(langs == lang, sizes)
                    if mine.any():
                        log_p[mine] = log_probabilities(codes[mine], sent.value, lang, s.order)
                sums = np.array([log_p[a:b].sum() for a, b in zip(texts.offsets[:-1], texts.offsets[1:])])
                yield record_batch(doc_id=part.column("doc_id"), lang=part.column("lang"), **base_statistics(texts), n_bytes=sizes, log_p=sums)

        return docs.mapInArrow(score, f"doc_id long, lang string, {_STATISTICS}, n_bytes long, log_p double")

    def statistics(batches):
        for part, texts in text_slices(batches):
            yield record_batch(doc_id=part.column("doc_id"), lang=part.column("lang"), **base_statistics(texts),
                               n_bytes=np.diff(texts.offsets), row=part.column("row"))

    def own_grams(batches):
        for part, texts in text_slices(batches):
            codes = grams(texts, s.order)
            for i, (a, b) in enumerate(zip(texts.offsets[:-1], texts.offsets[1:])):
                keys, n = np.unique(codes[a:b], return_counts=True)
                yield record_batch(row=np.repeat(part.column("row")[i].as_py(), len(keys)),
                                   lang=pa.array([part.column("lang")[i].as_py()] * len(keys), pa.string()), gram=keys, n=n)

    docs = docs.withColumn("row", F.monotonically_increasing_id())
    # Stored: the row numbers must be the same in both readings.
    docs = stored(docs, "numbered")
    full = model.where(F.col("size") == s.order).select("lang", "gram", F.log("p").alias("p"))
    sums = docs.mapInArrow(own_grams, "row long, lang string, gram long, n long").join(full, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("n") * F.col("p")).alias("log_p"))
    return (
        docs.mapInArrow(statistics, f"doc_id long, lang string, {_STATISTICS}, n_bytes long, row long")
        .join(sums, "row", "left").drop("row").withColumn("log_p", F.coalesce("log_p", F.lit(0.0)))
    )


def quality(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, perplexity, lower, upper) of every document.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows.  kept: not base_failed
    and the perplexity per byte lies within the bands of the document's language.  The bands are
    those of the documents that are not base_failed.

    A null text has no words and fails; a null language is a language of its own; repeated rows are
    counted and judged each for itself; a null doc_id stays null.  An empty table gives no rows;
    other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    model = stored(fit(count_grams(docs, s.order), s.order), "model")
    failed = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words"))
    scored = _scores(docs, model, s).withColumn("base_failed", failed)
    scored = stored(scored.withColumn("log_perplexity", F.when(F.col("n_bytes") > 0, -F.col("log_p") / F.col("n_bytes"))), "scored")
    sound = scored.where("NOT base_failed")
    middle = stored(sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle")), "middle")
    off = sound.join(middle, "lang").groupBy("lang", "middle").agg(
        F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000).alias("off"))
    bands = stored(off.select("lang", "middle", F.greatest(1.4826 * F.col("off"), F.lit(s.least_deviation)).alias("deviation")), "bands")
    width = F.col("deviation") + s.per_root / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    out = scored.join(bands, "lang", "left").withColumns({
        "lower": F.exp(F.col("middle") - s.below * width), "upper": F.exp(F.col("middle") + s.above * width),
        "perplexity": F.exp("log_perplexity")})
    within = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & within).alias("kept"), "perplexity", "lower", "upper")
