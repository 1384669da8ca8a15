"""Token ids as files of shuffled planes.

An id file holds blocks of a fixed number of ids. A block is transposed: byte k of all its ids, or bit k of all its ids, makes a
plane, and every plane is compressed by zstandard on its own; planes of zeros take no room. Layout, little-endian:

    IDPLANES                       8 bytes
    planes of block 0, 1, ...      zstandard frames, one behind the other
    footer                         zstandard frame: header (ids, block, planes, blocks, documents: 5 x u64), length of
                                   every plane (u32), document keys (i64), null marks (u8), ends of documents (u64)
    length of the footer (u64), IDPLANES

The lengths of the planes are the chunk index: any range of ids is read from the blocks it touches.

Documents lie in ascending order of their keys, over files whose names the manifest (a Parquet table beside them) lists. Tasks
give every file a name of its own and the manifest takes only rows of finished tasks, so a repeated task leaves no trace.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names

MAGIC = b"IDPLANES"
BLOCK = 1 << 16
#: Ids after which a new file begins, at the next end of a document.
FILE_IDS = 1 << 24
#: Ids that one batch of the reader holds, at least one document.
BATCH_IDS = 1 << 21
#: Chunks an encoder remembers, besides as many old ones.
MEMO = 700_000
#: Chunks that are encoded as one text.
JOINED = 200
SEPARATOR = re.compile("[\x1c-\x1f]")


class ChunkIds(dict):
    """Text between white space -> its ids as bytes (u32, little-endian).

    The tokenizer drops white space, so a text's ids are those of its chunks in order. A chunk of ASCII letters has the ids of
    its lower-case form, and a full stop or comma behind an ASCII letter is a token of its own: such chunks take their ids from
    shorter ones. When MEMO chunks are known they become the old ones, which stay until as many others have been met.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = min((x for x in self.tokenizer.get_added_tokens_decoder().items() if x[1].special and not x[1].normalized), default=None)
        self.old: dict[str, bytes] = {}
        self.mark_id, self.mark = (special[0], special[1].content) if special else (None, None)

    def _encode(self, chunks: list[str]) -> None:
        """Chunks are put between special tokens, which cut a text before anything else is done to it, and taken apart there."""
        odd = [c for c in chunks if self.mark in c]
        plain = [c for c in chunks if self.mark not in c]
        for chunk, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self[chunk] = np.array(e.ids, dtype="<u4").tobytes()
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            raw = ids.tobytes()
            for chunk, a, z in zip(part, [0, *(x + 4 for x in cut)], [*cut, len(raw)], strict=True):
                self[chunk] = raw[a:z]

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > MEMO:
            self.old = dict(self)
            self.clear()
            new = list(chunks)
        bodies, tails, old = set(), [], self.old
        for c in new:
            if c in old:
                self[c] = old[c]
            elif c[-1] in ".," and (before := c[-2:-1]).isalpha() and before.isascii():
                body = c[:-1]
                body = body.lower() if body.isascii() and body.isalpha() else body
                tails.append((c, body, c[-1]))
                bodies.add(body)
            elif c.isascii() and c.isalpha() and not c.islower():
                body = c.lower()
                tails.append((c, body, None))
                bodies.add(body)
            else:
                bodies.add(c)
        bodies |= {".", ","}
        self._encode([c for c in bodies if c not in self])
        for c, body, tail in tails:
            self[c] = self[body] + self[tail] if tail else self[body]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        # split() also takes the separators \x1c to \x1f for white space, the tokenizer does not
        split = [[t] if SEPARATOR.search(t) else t.split() for t in (t or "" for t in texts)]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, s)) for s in split]


class WholeTexts(ChunkIds):
    """The same for any tokenizer, by whole texts."""

    def texts(self, texts: list[str | None]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


@lru_cache(maxsize=2)
def encoder(path: str, chunked: bool) -> ChunkIds:
    """One encoder for all tasks of a worker, so that later tasks know the chunks of earlier ones."""
    return (ChunkIds if chunked else WholeTexts)(path)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Spark path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def to_planes(ids: np.ndarray, bits: bool) -> list[np.ndarray]:
    """Four byte planes, or 32 bit planes, of a block of ids."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits:
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little") for k in range(32)]
    return list(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T))


def from_planes(planes: list[np.ndarray | None], n: int) -> np.ndarray:
    """The block again; None is a plane of zeros."""
    out = np.zeros(n, dtype="<u4")
    if len(planes) == 4:
        by_byte = out.view(np.uint8).reshape(-1, 4)
        for k, p in enumerate(planes):
            if p is not None:
                by_byte[:, k] = p
    else:
        for k, p in enumerate(planes):
            if p is not None:
                out |= np.unpackbits(p, count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return out


class IdWriter:
    """One id file; at most a block of ids and the index are held."""

    def __init__(self, fs: pafs.FileSystem, path: str, block: int = BLOCK, bits: bool = False, level: int = 3) -> None:
        self.out, self.block, self.bits = fs.open_output_stream(path), block, bits
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.out.write(MAGIC)
        self.held, self.n_held, self.n = [], 0, 0
        self.sizes, self.keys, self.nulls, self.ends = [], [], [], []

    def add(self, key: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n += len(ids) // 4
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.ends.append(self.n)
        if self.n_held >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        at = 0
        while len(ids) - at >= max(least, 1):
            part = ids[at:at + self.block]
            for plane in to_planes(part, self.bits):
                packed = self.compress(plane.tobytes()) if plane.any() else b""
                self.out.write(packed)
                self.sizes.append(len(packed))
            at += len(part)
        self.held, self.n_held = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> None:
        self._flush(1)
        planes = 32 if self.bits else 4
        head = np.array([self.n, self.block, planes, len(self.sizes) // planes, len(self.ends)], dtype="<u8")
        footer = self.compress(b"".join([head.tobytes(), np.array(self.sizes, dtype="<u4").tobytes(), np.array(self.keys, dtype="<i8").tobytes(),
                                         np.array(self.nulls, dtype=np.uint8).tobytes(), np.array(self.ends, dtype="<u8").tobytes()]))
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class IdFile:
    """An id file for reading: `keys` (None for null), `ends` of its documents, and any range of its ids."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no id file")
        n = int.from_bytes(tail[:8], "little")
        self.expand = zstandard.ZstdDecompressor().decompress
        raw = self.expand(self.file.read_at(n, size - 16 - n))
        self.n, self.block, self.planes, blocks, docs = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        cuts = np.cumsum([40, 4 * blocks * self.planes, 8 * docs, docs])
        self.sizes = np.frombuffer(raw, "<u4", blocks * self.planes, cuts[0]).astype(np.int64)
        self.begin = len(MAGIC) + np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])
        keys, nulls = np.frombuffer(raw, "<i8", docs, cuts[1]).tolist(), np.frombuffer(raw, np.uint8, docs, cuts[2]).tolist()
        self.keys = [None if null else key for key, null in zip(keys, nulls)]
        self.ends = np.frombuffer(raw, "<u8", docs, cuts[3]).astype(np.int64)

    def _block(self, k: int) -> np.ndarray:
        n, first = min(self.block, self.n - k * self.block), k * self.planes
        raw = self.file.read_at(int(self.begin[first + self.planes] - self.begin[first]), int(self.begin[first]))
        cut = self.begin[first:first + self.planes + 1] - self.begin[first]
        return from_planes([np.frombuffer(self.expand(raw[a:z]), np.uint8) if z > a else None for a, z in zip(cut, cut[1:])], n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end), from the blocks they lie in."""
        if begin >= end:
            return np.zeros(0, dtype="<u4")
        first, last = begin // self.block, (end - 1) // self.block
        found = np.concatenate([self._block(k) for k in range(first, last + 1)])
        return found[begin - first * self.block:end - first * self.block]

    def documents(self) -> Iterator[list[tuple[int | None, int, bytes]]]:
        """(key, place of its first id, ids) of all documents in order, in lists of about BATCH_IDS ids; every block is read once."""
        part, size, rest, at, d = [], 0, [], 0, 0
        starts = np.concatenate([np.zeros(1, np.int64), self.ends])
        blocks = -(-self.n // self.block)
        for k in range(max(blocks, 1)):
            if k < blocks:
                rest.append(self._block(k).tobytes())
            upto = min((k + 1) * self.block, self.n)
            whole = int(np.searchsorted(self.ends, upto, side="right"))
            if whole > d:
                held = b"".join(rest)
                for i in range(d, whole):
                    a, z = int(starts[i]), int(starts[i + 1])
                    part.append((self.keys[i], a, held[4 * (a - at):4 * (z - at)]))
                    size += z - a
                rest, at, d = [held[4 * (int(starts[whole]) - at):]], int(starts[whole]), whole
            if size >= BATCH_IDS:
                yield part
                part, size = [], 0
        if part:
            yield part


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", chunked: bool = True,
              block: int = BLOCK, bits: bool = False, file_ids: int = FILE_IDS) -> None:
    """Encode every text, add `end_id` to each, and write id files in ascending order of `key` to a new folder `path`.

    Null and empty texts are just `end_id`. Null keys come first; equal keys are ordered by a hash of their texts, so that rows of
    one key can be dealt to many tasks; repeated rows are all written. An empty table gives a manifest without files. Extra columns
    are ignored, whatever their names. `chunked` holds for tokenizers that drop white space and lower-case; others need False.
    """
    fs, folder = place(path)
    fs.create_dir(folder, recursive=True)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(path)
        ids_of = encoder(tokenizer, chunked)
        part, done, writer, name = TaskContext.get().partitionId(), [], None, ""

        def finish() -> None:
            writer.close()
            done.append((part, len(done), name, len(writer.ends), writer.n))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                for k, ids in zip(rows.column(0).to_pylist(), ids_of.texts(rows.column(1).to_pylist())):
                    if writer is None:
                        name = f"{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.ids"
                        writer = IdWriter(fs, f"{folder}/{name}", block, bits)
                    writer.add(k, ids + end)
                    if writer.n >= file_ids:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "seq", "file", "n_docs", "n_ids"])

    rows = own_names(docs, key, text).toDF("k", "t").select(F.col("k").cast("bigint"), "t", F.xxhash64("t").alias("h"))
    # rows that tie in key and text are the same, so their order does not matter, but a hot one must be dealt out
    dealt = rows.withColumn("i", F.monotonically_increasing_id()).repartitionByRange("k", "h", "i")
    (dealt.sortWithinPartitions("k", "h", "t").select("k", "t")
     .mapInArrow(run, "part int, seq int, file string, n_docs bigint, n_ids bigint").write.parquet(f"{path}/manifest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_docs, n_ids, start): the files in order, with the ids before each."""
    files = spark.read.schema("part int, seq int, file string, n_docs bigint, n_ids bigint").parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row per task of the writer
             .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return files.join(parts, "part").select("file", "n_docs", "n_ids", start.alias("start"))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): all documents of a folder of id files; `ids` are u32, little-endian, `start` counts the ids before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(path)
        for b in batches:
            for row in b.to_pylist():
                for part in IdFile(fs, f"{folder}/{row['file']}").documents():
                    keys, starts, ids = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array([s + row["start"] for s in starts], pa.int64()), pa.array(ids, pa.binary())],
                        ["key", "start", "ids"])

    files = manifest(spark, path)
    n = files.count()
    return (files.select("file", "start").repartition(max(1, n))
            .mapInArrow(run, "key bigint, start bigint, ids binary").withColumnRenamed("key", key))
