"""Collocations from a suffix tree of words that is cut at depth 4 and built in independent parts.

The words of a language are keys of 64 bits.  Every word that has a follower in its piece begins a suffix
of two to four words.  Suffixes are dealt out by their prefix: first words fall into slots, slots are
put together into groups of at most ``budget`` suffixes, and a slot over the budget is divided by its
suffixes' first two words, then by whole suffixes.  A group is sorted by itself, which puts the
leaves of its subtrees in order; neighbours' common prefixes are the inner nodes, and a phrase's
count is the total of the leaves below it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Texts, mixed, powers, record_batch, stored

DEPTH = 4


@dataclass(frozen=True)
class Settings:
    """``least`` occurrences of a phrase, ``covered`` percent of its occurrences inside a longer one that
    drop it, ``top`` phrases of a language.  ``budget`` suffixes are a group's memory, ``slots`` its
    prefixes' hash range; ``flush`` suffixes are combined in a task before they are sent.  ``bits`` is
    the size of the filter of frequent words.
    """

    least: int = 30
    covered: int = 80
    top: int = 2000
    budget: int = 2_000_000
    slots: int = 1 << 16
    flush: int = 2_000_000
    bits: int = 1 << 23
    block: int = 2 << 20


#: Bytes: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(301, 557, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Words of more bytes are hashed one by one.
_LONG = 1024
_COUNTED = "kind int, key long, lang string, word string, n long"
_PHRASES = "words array<long>, n long"
_BLOCKS = "part int, suffixes binary"


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8"), 7))


class Words:
    """Words of a stretch of bytes: where they begin and end, which follow one another in a piece, their keys."""

    def __init__(self, data: np.ndarray, cut: np.ndarray):
        """``cut``: places in ``data`` where a text begins."""
        self.data = _LOWER[data]
        kind = _KIND[self.data]
        word = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[cut] = edge[0] = edge[-1] = True
        before = np.ones(len(data), bool)
        before[1:] = ~word[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        breaks = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)
        piece = breaks[self.start]
        #: Whether the next word lies in the same piece.
        self.followed = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)

    def keys(self, lang: np.ndarray) -> np.ndarray:
        """64 bits of each word in its language (a key per word); never 0."""
        length = self.end - self.start
        data, start, end = self.data, self.start, self.end
        long = np.flatnonzero(length > _LONG)
        if len(long):  # out of the running sums, whose memory is by bytes
            keep = np.ones(len(data) + 1, bool)
            for i in long:
                keep[start[i]:end[i]] = False
            gone = np.concatenate([[0], np.cumsum(~keep)])
            data = data[keep[:-1]]
            start, end = start - gone[start], end - gone[end]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
        key = (sums[end] - sums[start]) * down[start]
        for i in long:
            key[i] = np.uint64(xxhash.xxh64_intdigest(self.data[self.start[i]:self.end[i]].tobytes(), 3))
        key = mixed(key ^ lang)
        key[key == 0] = 1
        return key

    def texts(self, which: np.ndarray) -> pa.Array:
        """The words at these places, as strings."""
        length = (self.end - self.start)[which]
        offsets = np.concatenate([[0], np.cumsum(length)])
        data = self.data[np.arange(offsets[-1]) + np.repeat(self.start[which] - offsets[:-1], length)]
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        return made.cast(pa.large_string()).cast(pa.string())


def _next_gap(data: np.ndarray, at: int, gaps: int = 1) -> int:
    """The place after ``gaps`` runs of words from ``at`` on: where a separator follows a word, or the end."""
    step, inside, found = 1 << 16, None, 0
    while at < len(data):
        word = _KIND[data[at:at + step]] == 0
        previous = np.append(word[0] if inside is None else inside, word[:-1])
        ends = np.flatnonzero(previous & ~word)
        if found + len(ends) >= gaps:
            return at + int(ends[gaps - found - 1])
        found, inside, at = found + len(ends), bool(word[-1]), at + step
    return len(data)


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Words, np.ndarray, pa.Array, int]]:
    """Whole texts of about ``most`` bytes together, or a long text block by block.

    Gives the words, each one's row (a place in the array of languages that follows), and how many of the
    words begin suffixes here; the others belong to the next block and are there for what lies before.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, langs = Texts(batch.column("text")), batch.column("lang")
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + most, side="right")) - 1)
            first, last = int(texts.offsets[at]), int(texts.offsets[to])
            if last - first <= 2 * most:
                words = Words(texts.data[first:last], texts.offsets[at:to] - first)
                yield words, np.searchsorted(texts.offsets[at + 1:to], words.start + first, side="right") + at, langs, len(words.start)
            else:  # a single text
                data, begin = texts.data[first:last], 0
                while begin < len(data):
                    end = _next_gap(data, min(begin + most, len(data)))
                    words = Words(data[begin:_next_gap(data, end, DEPTH - 1)], np.zeros(1, np.int64))
                    yield words, np.full(len(words.start), at), langs, int(np.searchsorted(words.start, end - begin))
                    begin = end
            at = to


def _lang_keys(langs: pa.Array, known: dict[str, np.uint64]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each row the language's key; of each row its number among the distinct ones; these."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    keys = np.array([known.setdefault(x, _lang_key(x)) for x in names], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return keys[codes], codes, names


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xD1B54A32D192ED03) + b)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def counted(docs: DataFrame, s: Settings) -> DataFrame:
    """Counts of words (kind 0: key, lang, word) and of slots of pairs of words (kind 1: key)."""

    def work(batches: Iterator[pa.RecordBatch]):
        pairs, known = np.zeros(s.slots, np.int64), {}
        for words, row, langs, own in stretches(batches, s.block):
            if not own:
                continue
            lang, _, _ = _lang_keys(langs, known)
            key = words.keys(lang[row])
            at = np.flatnonzero(words.followed[:own])
            pairs += np.bincount((_pair(key[at], key[at + 1]) & np.uint64(s.slots - 1)).astype(np.int64), minlength=s.slots)
            distinct, first, n = np.unique(key[:own], return_index=True, return_counts=True)
            yield record_batch(kind=np.zeros(len(n), np.int32), key=distinct.view(np.int64), lang=langs.take(pa.array(row[first])), word=words.texts(first), n=n.astype(np.int64))
        slot = np.flatnonzero(pairs)
        none = pa.nulls(len(slot), pa.string())
        yield record_batch(kind=np.ones(len(slot), np.int32), key=slot, lang=none, word=none, n=pairs[slot])

    return _prepared(docs).mapInArrow(work, _COUNTED).groupBy("kind", "key", "lang", "word").agg(F.sum("n").alias("n"))


class Groups:
    """Which group a suffix belongs to, by its first word's slot, its first two words' slot, or all of it."""

    def __init__(self, firsts: np.ndarray, pairs: np.ndarray, budget: int):
        self.n = 0
        self.first = self._filled(firsts, budget)
        self.pair = np.zeros(len(pairs), np.int64)
        self.parts = np.zeros(len(pairs), np.int64)
        #: Groups from here on hold only a part of a pair's suffixes.
        self.partial = self.n
        if (self.first < 0).any():
            self.pair = self._filled(pairs, budget)
            self.partial = self.n
            for slot in np.flatnonzero(self.pair < 0):
                self.pair[slot], self.parts[slot] = self.n, -(-int(pairs[slot]) // budget)
                self.n += int(self.parts[slot])

    def _filled(self, counts: np.ndarray, budget: int) -> np.ndarray:
        """Slots one after the other into groups, as many as the budget takes; -1 for a slot beyond it."""
        out, held = np.full(len(counts), -1, np.int64), 0
        begun = False
        for slot, n in enumerate(counts.tolist()):
            if n > budget:
                continue
            if begun and held + n > budget:
                self.n, held = self.n + 1, 0
            out[slot], held, begun = self.n, held + n, True
        self.n += begun
        return out

    def of(self, keys: list[np.ndarray]) -> np.ndarray:
        mask = np.uint64(len(self.first) - 1)
        out = self.first[(keys[0] & mask).astype(np.int64)]
        hot = np.flatnonzero(out < 0)
        if len(hot):
            pair = _pair(keys[0][hot], keys[1][hot])
            slot = (pair & mask).astype(np.int64)
            whole = _pair(_pair(pair, keys[2][hot]), keys[3][hot])
            out[hot] = self.pair[slot] + (whole % np.maximum(self.parts[slot], 1).astype(np.uint64)).astype(np.int64)
        return out


def sorted_leaves(columns: list[np.ndarray], n: np.ndarray, values: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of small numbers (below ``values``) in order, equal ones joined with their counts summed."""
    bits = max(1, int(values - 1).bit_length())
    keys, room = [], 0
    for c in columns:  # as many columns to a 64-bit key as fit
        if room < bits:
            keys.append(np.zeros(len(n), np.uint64))
            room = 64
        keys[-1] = (keys[-1] << np.uint64(bits)) | c.astype(np.uint64)
        room -= bits
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at) if len(at) else n
    return [c[order[at]] for c in columns], total


def _encoded(columns: list[np.ndarray], n: np.ndarray, names: np.ndarray, zipped: zstandard.ZstdCompressor) -> bytes:
    """Suffixes in order as bytes: their distinct keys, then numbers of keys and counts, by byte planes."""
    used = np.unique(np.concatenate(columns))
    planes = b"".join(np.searchsorted(used, c).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    content = names[used].astype("<u8").tobytes() + planes + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<II", len(used), len(n)) + zipped.compress(content)


def _decoded(data: bytes, unzip: zstandard.ZstdDecompressor) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    distinct, rows = struct.unpack("<II", data[:8])
    content = np.frombuffer(unzip.decompress(data[8:]), np.uint8)
    names, at = content[:8 * distinct].view("<u8"), 8 * distinct
    columns = []
    for _ in range(DEPTH):
        columns.append(np.ascontiguousarray(content[at:at + 4 * rows].reshape(4, rows).T).view("<u4").ravel())
        at += 4 * rows
    return names, columns, np.ascontiguousarray(content[at:].reshape(8, rows).T).view("<i8").ravel()


def _sent(key: np.ndarray, depth: np.ndarray, groups: Groups, zipped) -> Iterator[pa.RecordBatch]:
    """The suffixes of a stream of words (depth 0 or 1: none begins here), combined and cut by groups."""
    names, number = np.unique(key, return_inverse=True)
    names, number = np.concatenate([np.zeros(1, np.uint64), names]), number + 1
    at = np.flatnonzero(depth > 1)
    deep = depth[at]
    columns = [np.where(deep > j, number[np.minimum(at + j, len(key) - 1)], 0) for j in range(DEPTH)]
    columns, n = sorted_leaves(columns, np.ones(len(at), np.int64), len(names))
    group = groups.of([names[c] for c in columns])
    order = np.argsort(group, kind="stable")
    group = group[order]
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    for lo, hi in zip(begin, np.append(begin[1:], len(group))):
        rows = order[lo:hi]
        yield record_batch(part=np.array([group[lo]], np.int32), suffixes=pa.array([_encoded([c[rows] for c in columns], n[rows], names, zipped)], pa.binary()))


def suffixes(docs: DataFrame, groups: Groups, frequent: np.ndarray, s: Settings) -> DataFrame:
    """(part, suffixes): blocks of truncated suffixes by groups.

    A suffix ends before a word that is surely rare, as no phrase with it is frequent enough; words the
    filter lets pass wrongly only make blocks larger.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        zipped, known = zstandard.ZstdCompressor(level=3), {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for words, row, langs, own in stretches(batches, s.block):
            if not own:
                continue
            lang, _, _ = _lang_keys(langs, known)
            key = words.keys(lang[row])
            bit = (key & np.uint64(s.bits - 1)).astype(np.int64)
            fine = (frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            depth = fine.astype(np.int8)
            for _ in range(DEPTH - 1):
                more = np.zeros(len(depth), np.int8)
                more[:-1] = np.where(words.followed[:-1], depth[1:], 0)
                depth = np.where(fine, np.minimum(more + 1, DEPTH), 0).astype(np.int8)
            depth[own:] = 0
            held.append((key, depth))
            n += own
            if n >= s.flush:
                yield from _sent(*(np.concatenate(x) for x in zip(*held)), groups, zipped)
                held, n = [], 0
        if held:
            yield from _sent(*(np.concatenate(x) for x in zip(*held)), groups, zipped)

    return _prepared(docs).mapInArrow(work, _BLOCKS)


def nodes(blocks: DataFrame, groups: Groups, least: int) -> DataFrame:
    """(words, n): the nodes at depth 2 to 4 of every group's subtrees.

    Nodes below ``least`` are left out, but for those of which other groups have suffixes too.
    """
    partial = groups.partial

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        unzip, part = zstandard.ZstdDecompressor(), key[0].as_py()
        found = [_decoded(b.as_py(), unzip) for b in rows.column("suffixes")]
        names = np.unique(np.concatenate([f[0] for f in found]))
        columns = [np.concatenate(c) for c in zip(*([np.searchsorted(names, own)[x] for x in cols] for own, cols, _ in found))]
        counts = np.concatenate([f[2] for f in found])
        del found
        columns, counts = sorted_leaves(columns, counts, len(names))
        absent = int(np.searchsorted(names, 0)) if len(names) and names[0] == 0 else -1
        out = []
        new = np.zeros(len(counts), bool)
        new[:1] = True
        for depth in range(1, DEPTH + 1):
            own = columns[depth - 1]
            new[1:] |= own[1:] != own[:-1]
            if depth == 1:
                continue
            at = np.flatnonzero(new)
            total = np.add.reduceat(counts, at)
            keep = own[at] != absent
            if part < partial or depth == DEPTH:
                keep &= total >= least
            at, total = at[keep], total[keep]
            keys = np.stack([names[c[at]] for c in columns[:depth]], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, depth), pa.int32()), pa.array(keys.ravel()))
            out.append(pa.record_batch([lists, pa.array(total)], names=["words", "n"]))
        return pa.Table.from_batches(out)

    rows = blocks.groupBy("part").applyInArrow(work, _PHRASES)
    return rows.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(words, a, l, r, score): each phrase with its lowest-scoring cut, the first of several."""
    counts = words.select(F.array("key").alias("words"), "n").unionByName(phrases.where(F.size("words") < DEPTH))
    cuts = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", 1, F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    # Whole numbers throughout: 2,000,000 a may pass 64 bits, the quotient never does.
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    cuts = cuts.withColumn("place", score * 8 + F.col("k"))
    best = cuts.groupBy("words").agg(F.min("place").alias("place"), F.min("a").alias("a"), F.min_by("l", "place").alias("l"), F.min_by("r", "place").alias("r"))
    return best.select("words", "a", "l", "r", F.expr("place div 8").alias("score"))


def uncovered(found: DataFrame, phrases: DataFrame, covered: int) -> DataFrame:
    """Phrases that no longer one holds in ``covered`` percent of their occurrences."""
    longer = phrases.where(F.size("words") > 2)
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")
    most = longer.select(F.explode(inner).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longest"))
    joined = found.join(most, "words", "left")
    return joined.where(F.col("longest").isNull() | (_big("longest") * 100 < _big("a") * covered)).drop("longest")


def mined(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to four words.

    docs has text and lang; a null text is empty, a null lang is ``und``.  Empty texts add nothing, texts
    of any length are read in blocks.  Equal scores come by more occurrences, then by the phrase's bytes;
    repeated rows count as often as they come.  An empty table gives no rows; other columns are ignored.
    """
    table = stored(counted(docs, s), "words")
    words = table.where("kind = 0").drop("kind")
    if not words.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("two words have one key")  # 64 bits: never for what one corpus holds
    words_n = words.where(F.col("n") >= s.least)
    slot = F.col("key").bitwiseAND(F.lit(s.slots - 1))
    totals = lambda rows: rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # noqa: E731  at most ``slots`` rows
    firsts, pairs = (np.zeros(s.slots, np.int64) for _ in range(2))
    for own, rows in ((firsts, words.select(slot.alias("slot"), "n")), (pairs, table.where("kind = 1").select(F.col("key").alias("slot"), "n"))):
        got = totals(rows)
        own[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    groups = Groups(firsts, pairs, s.budget)
    found = stored(nodes(suffixes(docs, groups, _frequent(words_n, s.bits), s), groups, s.least), "phrases")

    kept = stored(uncovered(scored(found, words_n), found, s.covered), "collocations")
    langs = words_n.select(F.col("key").alias("first"), "lang")
    kept = kept.withColumn("first", F.col("words")[0]).join(langs, "first").drop("first")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = stored(kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= s.top), "first")  # those that tie with the last too
    single = near.select("words", F.posexplode("words").alias("at", "key")).join(words_n.select("key", "word"), "key")
    named = single.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("named"))
    named = named.select("words", F.array_join(F.transform("named", lambda x: x["word"]), " ").alias("phrase"))
    rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = near.join(named, "words").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= s.top)
    totals_n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals_n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _frequent(words: DataFrame, bits: int) -> np.ndarray:
    """A bit per hash value that some frequent word has; ``bits`` / 8 bytes come to the driver."""
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    rows = words.select(F.bitmap_bucket_number(bit + 1).alias("bucket"), F.bitmap_bit_position(bit + 1).alias("at"))
    rows = rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("held")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, held in zip(rows.column("bucket").to_pylist(), rows.column("held")):
        part = np.frombuffer(held.as_buffer(), np.uint8)
        out[(bucket - 1) * len(part):bucket * len(part)] = part
    return out


ORACLE = """
WITH pieces AS MATERIALIZED (
    SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda w: w <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS MATERIALIZED (
    SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
    FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (
    SELECT c.lang, c.g, c.k, c.f AS a, j, l.f AS l, r.f AS r,
        CAST(CAST(2000000 AS HUGEINT) * c.f // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM grams WHERE k > 1) c
    JOIN grams l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, j)
    JOIN grams r ON r.lang = c.lang AND r.g = list_slice(c.g, j + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_grams AS (
    SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS f
    FROM grams, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE k > m AND i + m - 1 <= k GROUP BY ALL),
kept AS (
    SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inner_grams i ON i.lang = b.lang AND i.g = b.g
    WHERE i.f IS NULL OR CAST(100 AS HUGEINT) * i.f < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
