"""Substring dedup by level-wise doubling.

Level 1 looks at windows of half the length: only halves that occur in more than one document are extended, as windows whose
half is unique cannot repeat. Of all halves, those are taken that have the smallest hash among the halves of some full window:
equal windows agree on that half, so none is missed, and a thirteenth of the halves is shuffled instead of all. The windows that
took the same half lie next to each other; together they are a stretch of up to twice the full length.

Level 2 extends repeated halves to their stretches. A stretch that also stands in an earlier document is covered whole, and
only the earliest document of each stretch goes on, so large groups of copies shrink to one member here.

Level 3 is left with halves that stand in differing stretches, and compares their full windows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names
from pluvian.llm.hashing import WordHashes, groups, lowest, rolling, stretches
from pluvian.session import written

CHUNK_WORDS = 1 << 17
INT, LONG = pa.list_(pa.int32()), pa.list_(pa.int64())


def _flat(docs: list[list[bytes]], memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all documents in a row, and each document's begin and end."""
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    return np.array([memo[w] for d in docs for w in d], dtype=np.uint64), ends - sizes, ends


def _lists(rows: np.ndarray, docs: int, *values: np.ndarray) -> list[pa.Array]:
    """List columns from flat values; `rows` holds the document of each value, ascending."""
    offsets = pa.array(np.searchsorted(rows, np.arange(docs + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32)))
            for v in values]


def _packed(docs: DataFrame) -> DataFrame:
    """(key, h1, body): texts compressed, as they pass a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            body = [pack.compress((t.as_py() or "").encode()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(body, pa.binary())], ["key", "h1", "body"])
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, h1 bigint, body binary")


def _unpacked(column: pa.Array) -> Iterator[list[bytes]]:
    unpack = zstandard.ZstdDecompressor()
    return (unpack.decompress(t.as_py()).split() for t in column)


def _halves(docs: DataFrame, half: int, length: int) -> DataFrame:
    """One row per document with lists: starts of the `first` and `last` window that took a half, its hash `gram`, and the
    hash of the `stretch` from the first window's start to the last one's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            rows = ((i, (t.as_py() or "").encode().split()) for i, t in enumerate(b.column(2)))
            for part in groups(rows, lambda x: len(x[1]), CHUNK_WORDS):
                values, begins, ends = _flat([d for _, d in part], memo)
                grams = rolling(values, half)
                chosen = lowest(grams, length - half + 1)
                row = np.searchsorted(ends, np.arange(len(chosen)), side="right")
                starts = np.flatnonzero(ends[row] - np.arange(len(chosen)) >= length)
                took = chosen[starts]
                new = np.diff(took, prepend=-1) > 0  # places of halves ascend with the windows
                first = starts[new]
                last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] if len(starts) else starts
                at = row[first]
                cols = _lists(at, len(part), first - begins[at], last - begins[at], grams[took[new]],
                              stretches(values, first, last + length))
                keep = b.slice(part[0][0], len(part))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), *cols],
                                                 ["key", "h1", "first", "last", "gram", "stretch"])
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, h1 bigint, first array<int>, last array<int>, gram array<bigint>, "
                                "stretch array<bigint>")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """One row per document with lists of `start`, `gram` and `hash` of every window from `first` to `last` of `open`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            for i, ws in enumerate(_unpacked(b.column(2))):
                full = rolling(np.array([memo[w] for w in ws], dtype=np.uint64), length)
                first, last, gram = (b.column(3)[i].values.field(c).to_numpy() for c in range(3))
                size = last - first + 1
                start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                cols = _lists(np.zeros(len(start), dtype=int), 1, start, np.repeat(gram, size).view(np.uint64), full[start])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *cols],
                                                 ["key", "h1", "start", "gram", "hash"])
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, h1 bigint, start array<int>, gram array<bigint>, hash array<bigint>")


def _stripped(docs: DataFrame, length: int) -> DataFrame:
    """Texts without the words that the windows from `first` to `last` of `gone` cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for ws, gone in zip(_unpacked(b.column(1)), b.column(2)):
                n_words.append(len(ws))
                if gone.is_valid:
                    edges = np.zeros(len(ws) + 1, dtype=np.int64)
                    np.add.at(edges, gone.values.field(0).to_numpy(), 1)
                    np.add.at(edges, gone.values.field(1).to_numpy() + length, -1)
                    ws = [ws[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(ws))
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["key", "n_words", "n_removed", "text"])
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_words bigint, n_removed bigint, text string")


def _exploded(lists: DataFrame, *names: str) -> DataFrame:
    return (lists.where(F.col("key").isNotNull()).select("key", "h1", F.explode(F.arrays_zip(*names)).alias("z"))
            .select("key", "h1", *[F.col(f"z.{n}").alias(n) for n in names]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(key, n_words, n_removed, text): every document without the words that a repeated window covers.

    A window of `length` consecutive words is removed where the same words also start in a document with a smaller key;
    windows are judged on the input. What is left is joined by one space. Null and empty texts have no words, documents
    shorter than a window stay, rows without a key stay whole and are no one's origin, rows with the same key do not
    remove from each other, and an empty table gives no rows. Columns beyond the named ones are ignored.
    """
    rows = own_names(docs, key, text).toDF("key", "text").select("key", F.xxhash64("text").alias("h1"), "text")
    halves = _exploded(written(_halves(rows, length // 2, length)), "first", "last", "gram", "stretch")
    # sums are written before they are joined, so that Spark may split the rows of a very common half
    repeated = written(halves.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b")
                       .select("gram"))
    shared = written(halves.join(repeated, "gram"))

    earliest = written(shared.groupBy("gram", "stretch").agg(F.min("key").alias("least")))
    placed = shared.join(earliest, ["gram", "stretch"])
    covered = placed.where(F.col("key") > F.col("least")).select("key", "h1", "first", "last")
    differing = written(earliest.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    open_ = (placed.where(F.col("key") == F.col("least")).join(differing, "gram", "left_semi").groupBy("key", "h1")
             .agg(F.collect_list(F.struct("first", "last", "gram")).alias("open")))  # as many as the document has halves

    met = _packed(rows).join(open_, ["key", "h1"]).select("key", "h1", "body", "open")
    windows = _exploded(written(_windows(met, length)), "start", "gram", "hash")
    origin = written(windows.groupBy("gram", "hash").agg(F.min("key").alias("least"), F.max("key").alias("most"))
                     .where("least < most").drop("most"))
    single = windows.join(origin, ["gram", "hash"]).where(F.col("key") > F.col("least")).select(
        "key", "h1", F.col("start").alias("first"), F.col("start").alias("last"))
    gone = covered.unionByName(single).groupBy("key", "h1").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    return (_stripped(_packed(rows).join(gone, ["key", "h1"], "left").select("key", "body", "gone"), length)
            .withColumnRenamed("key", key))
