"""Tokenise documents and pack them into sequences of fixed length by bounded-space online best fit."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Tokens of a sequence, open bins of a packing task, items it takes.
CAPACITY, OPEN_BINS, ITEMS_PER_TASK = 2048, 2048, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = b"\0\0\0\0"
#: Fixed values of byte-level tokenizer files: how they cut texts, and the bytes that stand for themselves.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = (range(33, 127), range(161, 173), range(174, 256))


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE whose merges are in the order of their ids, else None."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    plain = [b for r in _PLAIN for b in r]
    signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


class Encoder:
    """Token ids of texts by a tokenizers file, as little-endian unsigned 32-bit values.

    A byte-level BPE file is run by tiktoken from the file's own vocabulary, which gives the same ids
    several times faster; any other file by tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._fast, added = None, spec.get("added_tokens", [])
        ranks = _ranks(spec)
        if ranks and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added):
            import tiktoken

            self._fast = tiktoken.Encoding("file", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def _one(self, text: str) -> bytes:
        if self._fast:
            try:
                return array("I", self._fast.encode(text, allowed_special="all")).tobytes()
            except Exception:  # its pattern matcher gives up on some very long runs
                pass
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: of a longer document, only the first is shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, slice_rows: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of documents (doc_id, text), end token 0 included.

    A null text is empty: its only token is the end token.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer).encode
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                out: list[list] = [[] for _ in range(5 + with_ids)]
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                    ids += _END
                    for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + length)]
                        for column, value in zip(out, (doc_id, i, start, length, zlib.crc32(own), own)):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names[:n])

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


class BestFit:
    """Open bins by free space; a bit set says which free spaces there are.

    An item goes to the fullest bin that takes it.  If none does and all ``limit`` bins are open, the
    fullest one closes first.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: dict[int, list[list]] = {}
        self.bits = self.n = 0

    def _take(self, free: int) -> list:
        stack = self.open[free]
        one = stack.pop()
        if not stack:
            del self.open[free]
            self.bits ^= 1 << free
        self.n -= 1
        return one

    def add(self, size: int, item) -> list[list]:
        """Place an item; returns the bins closed by that, each a list of (offset, item)."""
        closed = []
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.n == self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, own = self.capacity, []
        own.append((self.capacity - free, item))
        if free == size:
            closed.append(own)
        else:
            self.open.setdefault(free - size, []).append(own)
            self.bits |= 1 << (free - size)
            self.n += 1
        return closed

    def rest(self) -> Iterator[list]:
        for free in sorted(self.open):
            yield from self.open[free]


def _packed(items: DataFrame, capacity: int, limit: int) -> DataFrame:
    """Items (order, size, ...) of hashed partitions with _bin, _offset and _open, each task for itself."""
    ordered = items.sortWithinPartitions("order", *(c for c in items.columns if c != "order"))
    names = items.columns

    def work(batches):
        task, fit, n = TaskContext.get().partitionId(), BestFit(capacity, limit), 0
        schema = None

        def made(bins, is_open):
            nonlocal n
            rows, own, offsets = [], [], []
            for one in bins:
                for offset, row in one:
                    rows.append(row), own.append((task << 32) + n), offsets.append(offset)
                n += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), schema.types)] if rows else [pa.array([], k) for k in schema.types]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(own, pa.int64()), pa.array(offsets, pa.int64()), pa.array([is_open] * len(own), pa.bool_())],
                names=[*names, "_bin", "_offset", "_open"])

        for batch in batches:
            schema = batch.schema
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield made([b for size, row in zip(batch.column("size").to_pylist(), rows) for b in fit.add(size, row)], False)
        if schema is not None:
            yield made(fit.rest(), True)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ordered.mapInArrow(work, kinds + ", _bin long, _offset long, _open boolean")


def pack(parts: DataFrame, capacity: int = CAPACITY, limit: int = OPEN_BINS, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ...) with (sequence_id, offset).

    Pieces of full length are sequences of their own.  The others are dealt to tasks by a hash and
    packed there in the order of that hash; each bin a task leaves open then counts as one item of a
    second packing, in as many fewer tasks.  Every task's input and order are fixed by hashes and both
    packings read written tables, so a lost executor changes nothing.
    """
    parts = stored(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = parts.where(F.col("length") >= capacity).select(
        *parts.columns, (F.col("_row") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = parts.where(F.col("length") < capacity).select(
        F.xxhash64("doc_id", "piece", "ids_crc32", "_row").alias("order"), F.col("length").alias("size"), *parts.columns)
    tasks = max(1, -(-loose.count() // per_task))
    first = stored(_packed(loose.repartition(tasks, "order"), capacity, limit).drop("order", "size"), "packed")
    done = first.where("NOT _open").select(*parts.columns, (F.col("_bin") * 4 + 1).alias("sequence_id"), F.col("_offset").alias("offset"))

    left = first.where("_open")
    bins = left.groupBy("_bin").agg(F.sum("length").alias("size")).select(F.xxhash64("_bin").alias("order"), "size", F.col("_bin").alias("_part"))
    bins = stored(bins, "open-bins")
    tasks = max(1, -(-bins.count() // per_task))
    moved = stored(_packed(bins.repartition(tasks, "order"), capacity, limit).select(
        F.col("_part").alias("_bin"), (F.col("_bin") * 4 + 2).alias("sequence_id"), F.col("_offset").alias("_base")), "merged")
    again = left.join(moved, "_bin").select(*parts.columns, "sequence_id", (F.col("_base") + F.col("_offset")).alias("offset"))
    return full.unionByName(done).unionByName(again).drop("_row")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, limit: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): each piece's place.

    Null and empty texts are packed as their end token alone; null ids stay null.  Repeated rows are
    packed as often as they come.  Texts longer than a sequence are cut into full pieces, the first of
    which may be shorter.  An empty table gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity, with_ids), capacity, limit)
