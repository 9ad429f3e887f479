"""Token ids in files of independent zstandard frames with a trailing seek table and checksums.

A file holds, in this order:

* frames of up to ``frame_bytes`` of ids (little-endian unsigned 32-bit values, document after document),
  each compressed by itself, so that a reader decompresses only the frames a document lies in;
* a skippable frame with the documents' index: the file's place in the whole, and of each document its id and
  where it starts;
* a skippable frame with the seek table: of every frame before it the compressed length, the decompressed length
  (0 for the index) and the lower 32 bits of XXH64 over the decompressed bytes, then the footer.

Any zstandard decompressor turns a file into its ids; a reader of the public seekable format finds every frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import record_batch, stored
from .packing import encoder

#: Ids of a frame and of a file, in bytes before compression; characters that are encoded at a time.
FRAME_BYTES, FILE_BYTES, BLOCK_CHARS = 1 << 16, 1 << 25, 1 << 18
#: Documents of a file at most.
FILE_DOCS = 1 << 18

#: Fixed values of the format: skippable frames' magic numbers, the footer's, and the flag of checksums.
_INDEX_MAGIC, _TABLE_MAGIC, _FOOTER_MAGIC, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.pack("<I", _FOOTER_MAGIC)
_OWN = b"ids1"

DOCUMENT = "part long, file long, doc_id long, at long, n_tokens long, ids_crc32 long"
INDEX = "path string, part long, file long, doc_id long, at long, n_tokens long"


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FileWriter:
    """Collects documents and gives the file's bytes; frames are compressed as they fill."""

    def __init__(self, part: int, file: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.part, self.file, self.frame_bytes = part, file, frame_bytes
        self._zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._frames: list[bytes] = []
        self._entries: list[tuple[int, int, int]] = []
        self._open = bytearray()
        self._doc_ids: list[int | None] = []
        self._at: list[int] = []
        self.size = 0

    def __len__(self) -> int:
        return len(self._doc_ids)

    def begin(self, doc_id: int | None) -> None:
        self._doc_ids.append(doc_id)
        self._at.append(self.size // 4)

    def add(self, ids: bytes) -> None:
        """Further ids of the document begun last."""
        self._open += ids
        self.size += len(ids)
        while len(self._open) >= self.frame_bytes:
            self._close(bytes(self._open[:self.frame_bytes]))
            del self._open[:self.frame_bytes]

    def _close(self, data: bytes) -> None:
        frame = self._zip.compress(data)
        self._frames.append(frame)
        self._entries.append((len(frame), len(data), _checksum(data)))

    def finish(self) -> bytes:
        if self._open:
            self._close(bytes(self._open))
        known = np.array([d is not None for d in self._doc_ids], bool)
        ids = np.array([d or 0 for d in self._doc_ids], "<i8")
        columns = ids.tobytes() + np.array(self._at, "<i8").tobytes() + np.packbits(known).tobytes()
        head = _OWN + struct.pack("<qqqqI", self.part, self.file, len(ids), self.size // 4, _checksum(columns))
        index = _skippable(_INDEX_MAGIC, head + self._zip.compress(columns))
        entries = [*self._entries, (len(index), 0, _checksum(b""))]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IB", len(entries), _CHECKSUMS) + _FOOTER
        return b"".join([*self._frames, index, _skippable(_TABLE_MAGIC, table)])


class FileReader:
    """Reads a file's bytes from its end: the seek table, then the index, then only the frames asked for."""

    def __init__(self, data):
        self.data = memoryview(data)
        if len(self.data) < 17 or bytes(self.data[-4:]) != _FOOTER:
            raise ValueError("no seek table at the end of the file")
        n, flags = struct.unpack("<IB", self.data[-9:-4])
        width = 12 if flags & _CHECKSUMS else 8
        begin = len(self.data) - 9 - n * width
        if begin < 8 or struct.unpack("<II", self.data[begin - 8:begin]) != (_TABLE_MAGIC, n * width + 9):
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self.data[begin:begin + n * width], "<u4").reshape(n, width // 4).astype(np.int64)
        #: Where frame i begins, compressed and decompressed.
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.checksums = table[:, 2] if width == 12 else None
        if self.packed[-1] != begin - 8:
            raise ValueError("the seek table does not fit the file")
        self._unzip = zstandard.ZstdDecompressor()
        self.opened = 0
        self._read_index(n - 1)

    def _read_index(self, i: int) -> None:
        frame = self.data[self.packed[i]:self.packed[i + 1]]
        if struct.unpack("<I", frame[:4])[0] != _INDEX_MAGIC or bytes(frame[8:12]) != _OWN:
            raise ValueError("no index of documents before the seek table")
        self.part, self.file, n, tokens, checksum = struct.unpack("<qqqqI", frame[12:48])
        columns = self._unzip.decompress(frame[48:])
        if _checksum(columns) != checksum:
            raise ValueError("the index of documents is damaged")
        self.doc_ids = np.frombuffer(columns, "<i8", n)
        self.at = np.append(np.frombuffer(columns, "<i8", n, 8 * n), tokens)
        self.known = np.unpackbits(np.frombuffer(columns, np.uint8, -1, 16 * n), count=n).astype(bool)

    def frame(self, i: int) -> bytes:
        """The ids of frame i, its checksum compared."""
        data = self._unzip.decompress(self.data[self.packed[i]:self.packed[i + 1]])
        self.opened += 1
        if self.checksums is not None and _checksum(data) != self.checksums[i]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def tokens(self, at: int, n: int) -> bytes:
        """n ids from the file's id ``at`` on; opens only the frames they lie in."""
        first, last = 4 * at, 4 * (at + n)
        i = int(np.searchsorted(self.plain, first, side="right")) - 1
        out = []
        while first < last:
            begin = int(self.plain[i])
            out.append(self.frame(i)[first - begin:last - begin])
            first = int(self.plain[i + 1])
            i += 1
        return b"".join(out)

    def checked(self) -> Iterator[tuple[int, int]]:
        """(n_tokens, crc32) of every document in turn; each frame is opened once."""
        crc, done, i = 0, 0, 0
        ends = 4 * self.at[1:]
        for k in range(len(self.plain) - 2):
            data, base = memoryview(self.frame(k)), int(self.plain[k])
            while i < len(ends) and ends[i] <= base + len(data):
                crc = zlib.crc32(data[done - base:ends[i] - base], crc)
                yield int(self.at[i + 1] - self.at[i]), crc
                crc, done, i = 0, int(ends[i]), i + 1
            if done < base + len(data):
                crc, done = zlib.crc32(data[done - base:], crc), base + len(data)
        if i < len(ends):
            raise ValueError("the file ends before its documents")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut a long text where byte-level tokenizers cut as well: before a single space between two letters.

    A text without such a place goes on to its end, so the ids are those of the whole text.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if text[cut - 1].isalpha() and text[cut + 1].isalpha():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all documents (doc_id, text), each with the end id, in ascending order of doc_id.

    Texts are dealt out by ranges of doc_id; a task encodes its documents in order and makes a file of
    every ``file_bytes`` of ids, a long document's being bounded by that document.  Documents of one id
    come in the order of a hash of their texts; copies that are equal in both are spread over tasks too,
    by where they lie in the table, which must therefore be one that is read from files.  Files are written
    by Spark's text writer, a row each, whose line separator is the four bytes that end the format.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = d.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text", "row").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]):
        part, n = TaskContext.get().partitionId(), 0
        encode, own = encoder(tokenizer).encode, None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                own = own or FileWriter(part, n, frame_bytes)
                own.begin(doc_id.as_py())
                for block in blocks(text.as_py()):
                    own.add(encode([block])[0])
                own.add(end)
                if own.size >= file_bytes or len(own) >= FILE_DOCS:
                    yield record_batch(value=pa.array([own.finish()[:-len(_FOOTER)]], pa.binary()))
                    own, n = None, n + 1
        if own:
            yield record_batch(value=pa.array([own.finish()[:-len(_FOOTER)]], pa.binary()))

    files = ordered.mapInArrow(work, "value binary").select(F.col("value").cast("string"))
    (files.write.option("lineSep", _FOOTER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", 1).text(path))


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).where(F.col("length") > 0).select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per document from the files: where it lies, its number of ids and their crc32; every frame is checked."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column("content"):
                file = FileReader(content.as_buffer())
                found = np.array(list(file.checked()), np.int64).reshape(-1, 2)
                yield record_batch(
                    part=np.full(len(found), file.part), file=np.full(len(found), file.file), doc_id=pa.array(file.doc_ids, mask=~file.known),
                    at=file.at[:-1], n_tokens=found[:, 0], ids_crc32=found[:, 1])

    return _files(spark, path).select("content").mapInArrow(work, DOCUMENT)


def started(documents: DataFrame) -> DataFrame:
    """read() with ``start``: the ids of all documents before, in the order of parts, files and places.

    A file's ids are summed up first; what is ordered as a whole is a row per part, of which there are
    as many as tasks wrote.
    """
    files = documents.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    own = files.select("part", "file", before(Window.partitionBy("part").orderBy("file")).alias("inside"))
    bases = own.join(parts, "part").select("part", "file", (F.col("base") + F.col("inside")).alias("base"))
    return documents.join(bases, ["part", "file"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "file")


def write_index(spark: SparkSession, path: str) -> None:
    """Keep the files' own indexes as a table beside them, which readers of files pass over."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                file = FileReader(content.as_buffer())
                n = len(file.doc_ids)
                yield record_batch(
                    path=pa.array([name.as_py()] * n, pa.string()), part=np.full(n, file.part), file=np.full(n, file.file),
                    doc_id=pa.array(file.doc_ids, mask=~file.known), at=file.at[:-1], n_tokens=np.diff(file.at))

    _files(spark, path).mapInArrow(work, INDEX).write.mode("overwrite").parquet(f"{path}/_index")


def fetch(spark: SparkSession, path: str, wanted: DataFrame, most_listed: int = 1000) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``wanted``; needs write_index().

    Of each file only the frames in which they lie are decompressed and checked.  Up to
    ``most_listed`` files are opened by name; where more are needed, all are listed and joined.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/_index")
    found = index.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    found = stored(found.groupBy("path").agg(F.collect_list(F.struct("doc_id", "at", "n_tokens")).alias("asked")), "asked")
    names = [r.path for r in found.select("path").limit(most_listed + 1).collect()]
    if not names:
        return spark.createDataFrame([], "doc_id long, ids binary")
    files = _files(spark, names if len(names) <= most_listed else path)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content, asked in zip(batch.column("content"), batch.column("asked")):
                file = FileReader(content.as_buffer())
                for one in asked.as_py():
                    yield record_batch(doc_id=pa.array([one["doc_id"]], pa.int64()), ids=pa.array([file.tokens(one["at"], one["n_tokens"])], pa.binary()))

    return files.join(found, "path").select("content", "asked").mapInArrow(work, "doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write documents (doc_id, text) as files and read them back: (doc_id, start, n_tokens, ids_crc32, part, file).

    A null or empty text has the end id alone.  Documents of a null id come first and keep it null;
    repeated rows are written as often as they come, one after the other.  A text of any length is
    encoded in blocks and may fill many frames.  An empty table gives no rows; other columns are ignored.
    """
    path = path or scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id)
    return started(stored(read(docs.sparkSession, path), "token-documents"))
