"""Phrase collocations, counted in counting quotient filters.

Texts are cut into pieces and words once, and stored in blocks: each with its own list of words and the text as numbers of that list.
Word counts of all blocks give the words that a phrase can hold (a phrase is never more frequent than its words); they get dense
ids, and each block gets the ids of its own words back, so no task needs the whole vocabulary.

A phrase of two or three words is packed into three ids, and the packed bits go through a Feistel network: an invertible
permutation that spreads phrases evenly. The first bits of the result are the segment, the next the quotient, and the full rest
is the remainder, so a filter loses nothing. Filters are sorted by quotient and remainder; those of a segment are
merged over all tasks, and inverting the permutation gives the phrases back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvian.functions.skew import rows_below
from pluvian.llm.columns import own_names
from pluvian.llm.hashing import mixed
from pluvian.session import written

#: A-Z as a-z; marks and line ends that end a piece as \n; tab as space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
#: Words of a block, and bytes of text that are cut at once (longer texts are cut at ends of pieces).
BLOCK_WORDS = 1 << 20
SLICE_BYTES = 1 << 22
#: Phrases that a task gathers before it folds them, and entries of its filter before it sends them on.
FRESH = 1 << 20
HELD = 1 << 22
#: First bits by which entries are cut into slices that are sorted one at a time.
SLICE_BITS = 4
#: Phrases (repeats counted) of a segment.
SEGMENT = 1 << 22
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


class Words(dict):
    """Word -> its number in a block, from 1; 0 ends a piece, -1 is the nothing between two spaces."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})
        self.found: list[bytes] = []
        self.codes: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        self.found.append(word)
        value = self[word] = len(self.found)
        return value

    def add(self, text: bytes) -> int:
        codes = np.fromiter(map(self.__getitem__, text.replace(b"\n", b" \n ").split(b" ")), dtype=np.int32)
        codes = codes[codes >= 0]
        self.codes += [codes, np.zeros(1, dtype=np.int32)]
        return len(codes)

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.found) + 1)[1:]
        return self.found, counts, zstandard.ZstdCompressor(level=1).compress(codes.tobytes())


def slices(text: bytes) -> Iterator[bytes]:
    """A folded text in parts that end where a piece ends."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, words, counts, codes) for rows (lang, text); a block holds texts of one language."""
    names = ["block", "lang", "words", "counts", "codes"]
    types = (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, size = TaskContext.get().partitionId() << 33, {}, 0

        def out() -> pa.RecordBatch:
            rows = [(number + i, lang, *w.row()) for i, (lang, w) in enumerate(open_.items())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for part in slices((text or b"").translate(FOLDED)):
                    if lang not in open_:
                        open_[lang] = Words()
                    size += open_[lang].add(part)
                    if size >= BLOCK_WORDS:
                        yield out()
                        number, open_, size = number + len(open_), {}, 0
        if open_:
            yield out()
    return docs.mapInArrow(run, "block bigint, lang string, words array<binary>, counts array<bigint>, codes binary")


@dataclass(frozen=True)
class Layout:
    """Packed phrases of ids below 2^bits: `hi` has the first id, `lo` the other two, and the permutation keeps those widths."""

    bits: int
    segment_bits: int

    def turned(self, hi: np.ndarray, lo: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The permutation, or its inverse."""
        high, low = np.uint64((1 << self.bits) - 1), np.uint64((1 << 2 * self.bits) - 1)
        for k in range(len(ROUNDS))[::-1 if back else 1]:
            if k % 2 == 0:
                hi = hi ^ (mixed(lo + np.uint64(ROUNDS[k])) & high)
            else:
                lo = lo ^ (mixed(hi + np.uint64(ROUNDS[k])) & low)
        return hi, lo

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        return self.turned(a, b << np.uint64(self.bits) | np.uint64(c) if isinstance(c, int) else b << np.uint64(self.bits) | c)

    def unpack(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, rest = self.turned(hi, lo, back=True)
        return a, rest >> np.uint64(self.bits), rest & np.uint64((1 << self.bits) - 1)

    def folded(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Entries:
        """Sorted, with the counts of equal phrases added up; sorted runs in the input cost little."""
        if not len(hi):
            return hi, lo, n
        if 3 * self.bits <= 64:
            order = np.argsort(hi << np.uint64(2 * self.bits) | lo, kind="stable")
        else:
            order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return hi[first], lo[first], np.add.reduceat(n, first)

    def slices(self, entries: Entries, bits: int, numbers: range | None = None) -> Iterator[Entries]:
        """Sorted entries, cut by the first `bits` of `hi`: those of each number in turn (of all numbers by default)."""
        numbers = range(1 << bits) if numbers is None else numbers
        first = np.arange(numbers.start, numbers.stop, dtype=np.uint64)[1:] << np.uint64(self.bits - bits)
        cut = [0, *np.searchsorted(entries[0], first).tolist(), len(entries[0])]
        for a, z in zip(cut, cut[1:]):
            yield tuple(x[a:z] for x in entries)

    def segments(self, entries: Entries) -> Iterator[tuple[int, bytes]]:
        """The filter of every segment that sorted entries fall into."""
        hi, lo, n = entries
        shift = np.uint64(self.bits - self.segment_bits)
        part = (hi >> shift).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, z in zip(cut, cut[1:]):
            rest = hi[a:z] & np.uint64((1 << int(shift)) - 1)
            yield int(part[a]), encoded(rest, lo[a:z], n[a:z], int(shift), 2 * self.bits)

    def segment(self, number: int, packed: bytes) -> Entries:
        shift = self.bits - self.segment_bits
        rest, lo, n = decoded(packed, shift, 2 * self.bits)
        return rest | np.uint64(number << shift), lo, n


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low `bits` of each number, a byte plane after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].T).tobytes()


def _numbers(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = (bits + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64), at + n * size


def encoded(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, high: int, low: int) -> bytes:
    """A filter of sorted distinct entries, `hi` of `high` bits and `lo` of `low` bits, with their counts.

    The quotient is as many first bits of `hi` as leave about one entry a slot. A bit a slot marks the quotients that occur, a bit an
    entry the last of each quotient's run; then come the remainders, a byte for each count, and the counts that need more.
    """
    size = len(hi)
    q = max(0, min(high, size.bit_length() - 1))
    rest = high - q
    slot = (hi >> np.uint64(rest)).astype(np.int64)
    used = np.zeros(1 << q, dtype=np.uint8)
    used[slot] = 1
    last = np.append(slot[1:] != slot[:-1], True).astype(np.uint8)
    large = n >= 255
    return b"".join([size.to_bytes(8, "little"), np.packbits(used).tobytes(), np.packbits(last).tobytes(),
                     _planes(hi & np.uint64((1 << rest) - 1), rest), _planes(lo, low),
                     np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype("<i8").tobytes()])


def decoded(raw: bytes, high: int, low: int) -> Entries:
    size = int.from_bytes(raw[:8], "little")
    q = max(0, min(high, size.bit_length() - 1))
    rest, at = high - q, 8
    used = np.unpackbits(np.frombuffer(raw, np.uint8, ((1 << q) + 7) // 8, at), count=1 << q)
    at += ((1 << q) + 7) // 8
    last = np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size)
    at += (size + 7) // 8
    runs = np.diff(np.flatnonzero(last), prepend=-1)
    slot = np.repeat(np.flatnonzero(used), runs).astype(np.uint64)
    hi, at = _numbers(raw, at, size, rest)
    lo, at = _numbers(raw, at, size, low)
    n = np.frombuffer(raw, np.uint8, size, at).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", int((n == 255).sum()), at + size)
    return slot << np.uint64(rest) | hi, lo, n


def phrase_filters(coded: DataFrame, layout: Layout) -> DataFrame:
    """(segment, filter) for rows (codes, local, id): all phrases of two and three words that have ids, counted by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = Held(layout), [], 0
        step = max(1, FRESH // 4)

        def out() -> Iterator[pa.RecordBatch]:
            for entries in held.taken():
                number, filters = zip(*layout.segments(entries))
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(filters, pa.binary())], ["segment", "filter"])
        for b in batches:
            for i in range(b.num_rows):
                codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column(0)[i].as_py()), np.int32)
                ids = np.zeros(int(codes.max()) + 1, dtype=np.uint64)
                ids[b.column(1)[i].values.to_numpy()] = b.column(2)[i].values.to_numpy()
                for at in range(0, len(codes), step):
                    y = ids[codes[at:at + step + 2]]
                    two = (y[:-1] > 0) & (y[1:] > 0)
                    three = two[:-1] & two[1:]
                    two = two[:step]  # the next part begins with what this one ends with
                    fresh.append(layout.pack(y[:-1][:step][two], y[1:][:step][two], 0))
                    fresh.append(layout.pack(y[:-2][three], y[1:-1][three], y[2:][three]))
                    size += len(fresh[-1][0]) + len(fresh[-2][0])
                    if size >= FRESH:
                        held.add(fresh)
                        size = 0
                        if held.size >= HELD:
                            yield from out()
        held.add(fresh)
        yield from out()
    return coded.select("codes", "local", "id").mapInArrow(run, "segment int, filter binary")


class Held:
    """Counted phrases of a task, in slices by the first bits of `hi`: only one slice at a time is copied to add more."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.bits = layout, min(SLICE_BITS, layout.bits)
        self.parts: list[Entries | None] = [None] * (1 << self.bits)
        self.size = 0

    def add(self, fresh: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Counts the (hi, lo) of `fresh`, which is emptied."""
        if not fresh:
            return
        hi, lo = (np.concatenate(x) for x in zip(*fresh))
        fresh.clear()
        new = self.layout.folded(hi, lo, np.ones(len(hi), dtype=np.int64))
        self.size = 0
        for k, more in enumerate(self.layout.slices(new, self.bits)):
            old = self.parts[k]
            if len(more[0]):
                both = more if old is None else tuple(np.concatenate(x) for x in zip(old, more))
                self.parts[k] = tuple(x.copy() for x in both) if old is None else self.layout.folded(*both)
            self.size += 0 if self.parts[k] is None else len(self.parts[k][0])

    def taken(self) -> Iterator[Entries]:
        """The entries of each slice, which is empty afterwards."""
        for k, entries in enumerate(self.parts):
            self.parts[k] = None
            if entries is not None:
                yield entries
        self.size = 0


def merged(filters: DataFrame, layout: Layout, least: int) -> DataFrame:
    """(a, b, c, n): phrases that occur at least `least` times, as word ids, c = 0 for two words."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, bits = key[0].as_py(), min(layout.segment_bits + SLICE_BITS, layout.bits)
        parts = [layout.segment(number, f.as_py()) for f in table["filter"]]
        own = range(number << bits - layout.segment_bits, (number + 1) << bits - layout.segment_bits)
        found = []
        for same in zip(*(layout.slices(p, bits, own) for p in parts)):
            hi, lo, n = layout.folded(*(np.concatenate(x) for x in zip(*same)))
            keep = n >= least
            found.append((*layout.unpack(hi[keep], lo[keep]), n[keep]))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["a", "b", "c", "n"])
    return filters.groupBy("segment").applyInArrow(run, "a bigint, b bigint, c bigint, n bigint")


def association(n: Column, left: Column, right: Column) -> Column:
    """floor(10^6 * n * n / (left * right)), exact up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (n, left, right)]
    top = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of every language.

    `a` counts the phrase, `l` and `r` its parts at the cut of the lowest score (the first one of equals), `n` all words of the
    language. A phrase within a longer one that has at least `cover` percent of its count is left out. Null languages are
    `und`, together with those called so. Null and empty texts have no words; repeated rows count as often as they
    occur; an empty table, or one without a phrase of `least` occurrences, gives no rows. Equal scores are ordered by count, then
    by the bytes of the phrase. Extra columns are ignored, whatever their names.
    """
    rows = own_names(docs, lang, text).toDF("lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = written(blocks(rows))
    each = found.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", "lang", (F.col("pos") + 1).cast("int").alias("local"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    counts = written(each.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    usable = counts.where(F.col("n") >= least)
    words = written(rows_below(usable.select(F.struct("lang", "word").alias("key"), "n", F.lit(1).alias("one")), [], "key", "one", "below")
                    .select("key.lang", "key.word", "n", (F.col("below") + 1).alias("id")))
    n_words, occurrences = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(1, n_words.bit_length())
    layout = Layout(bits, min(bits, max(0, (2 * occurrences // SEGMENT).bit_length())))
    known = each.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("local", "id")).alias("known"))  # at most the words of a block
    coded = found.select("block", "codes").join(known, "block").select("codes", F.col("known.local").alias("local"), F.col("known.id").alias("id"))
    phrases = written(merged(phrase_filters(coded, layout), layout, least))
    return _ranked(phrases, words, totals, cover, top)


def _ranked(phrases: DataFrame, words: DataFrame, totals: DataFrame, cover: int, top: int) -> DataFrame:
    def word(name: str, *more: str) -> DataFrame:
        return words.select(F.col("id").alias(name), *more)

    two = (phrases.where("c = 0").select("a", "b", "n").join(word("a", "lang", F.col("n").alias("na")), "a")
           .join(word("b", F.col("n").alias("nb")), "b"))
    two = written(two.select("lang", "a", "b", "n", "na", "nb"))
    three = phrases.where("c > 0")
    front = two.select("lang", "a", "b", F.col("n").alias("nab"), "na")
    back = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("nbc"), F.col("nb").alias("nc"))
    cuts = (three.join(front, ["a", "b"]).join(back, ["b", "c"])
            .withColumn("first", association(F.col("n"), F.col("na"), F.col("nbc")))
            .withColumn("second", association(F.col("n"), F.col("nab"), F.col("nc"))))
    early = F.col("first") <= F.col("second")
    three_scored = cuts.select("lang", "a", "b", "c", "n", F.when(early, F.col("na")).otherwise(F.col("nab")).alias("l"),
                               F.when(early, F.col("nbc")).otherwise(F.col("nc")).alias("r"), F.least("first", "second").alias("score"))
    inside = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    longer = three.select(inside.alias("p"), "n").groupBy("p.a", "p.b").agg(F.max("n").alias("most"))
    alone = two.join(longer, ["a", "b"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("n")))
    two_scored = alone.select("lang", "a", "b", F.lit(0).cast("bigint").alias("c"), "n", F.col("na").alias("l"), F.col("nb").alias("r"),
                              association(F.col("n"), F.col("na"), F.col("nb")).alias("score"))
    scored = two_scored.unionByName(three_scored)
    # the best of every part of a language, with ties; then of the language; ties are ordered by the words at last
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.col("score").desc(), F.col("n").desc()]
    some = scored.withColumn("part", F.pmod(F.xxhash64("a", "b", "c"), F.lit(parts)))
    for keys in (["lang", "part"], ["lang"]):
        some = some.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("place") <= top)
    named = (some.join(word("a", F.col("word").alias("wa")), "a").join(word("b", F.col("word").alias("wb")), "b")
             .join(word("c", F.col("word").alias("wc")), "c", "left"))
    space = F.lit(b" ")
    named = named.withColumn("raw", F.when(F.col("wc").isNull(), F.concat("wa", space, "wb"))
                             .otherwise(F.concat("wa", space, "wb", space, "wc")))
    order = Window.partitionBy("lang").orderBy(*best, F.col("raw"))
    return (named.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", F.col("raw").cast("string").alias("phrase"), F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score"))
