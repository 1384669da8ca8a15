"""Benchmark decontamination by spaced seeds.

Every mask names positions of a run of words; the words at its other positions are ignored, so a substituted word spoils
only the masks that look at it. The masks are chosen so that no overlap that counts escapes all of them. Masked hashes of test
items and documents meet in a join; around each hit the two texts are compared word by word along the hit's diagonal, and all
overlaps that are long and alike enough count.

Before the join, documents drop hashes that no test item can have, by a bit field of fixed size. A larger test set makes the
field fuller and the join larger, never the result smaller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names
from pluvian.llm.hashing import MEMO_WORDS, groups, mixed
from pluvian.session import written

#: Every stretch of twelve words or more with equal ends and four of five words equal holds one of these, whatever its length:
#: a stretch without any has a score (0.2 an equal word, -0.8 another) of at most AWAY - FALL * words, and below 0 from twelve on.
MASKS = ("1101111", "111010000011", "1101000111", "1110111")
SPAN = max(map(len, MASKS))
ALIKE = Fraction(4, 5)
AWAY, FALL = Fraction(2), Fraction(2, 25)
#: Shorter test items are looked up as a whole; those under LEAST_WORDS words must be equal throughout and have LEAST_CHARS
#: characters, since a word or two stand in any text.
LEAST_WORDS = 5
LEAST_CHARS = 12
FIELD_BITS = 24
CHUNK_WORDS = 1 << 17
#: Letters of Thai, Lao, Burmese, Khmer, Chinese and Japanese, which are written without spaces.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W{UNSPACED}]+|(?=\w)[{UNSPACED}]")


class Tokens(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores, single letters in UNSPACED scripts; other signs count for nothing."""
    return TOKEN.findall((text or "").lower())


def exact(alike: float) -> Fraction:
    """The share as it is written: 0.8 is four fifths."""
    return Fraction(str(alike))


def masks(least: int, alike: float) -> tuple[str, ...]:
    """MASKS where they miss nothing; for shorter or less alike stretches, the whole run that each of them must hold."""
    if least >= SPAN and exact(alike) >= ALIKE:
        return MASKS
    other = [int(n * (1 - exact(alike))) for n in range(least, least + 1000)]
    return ("1" * max(1, min(-(-(n - m) // (m + 1)) for n, m in enumerate(other, least))),)


def reach(words: int, least: int, alike: float) -> int:
    """How far a stretch that counts can go on to either side of `words` words that hold all its hits."""
    used, gain = masks(least, alike), 1 - exact(alike)
    n = len(used[0])
    away, fall = (AWAY, FALL) if used == MASKS else (Fraction(n - 1, n), Fraction(1, n) - gain)
    return max(least, int((gain * words + 2 * away) / fall) + 1)


@lru_cache
def patterns(least: int, alike: float) -> tuple[list[np.ndarray], dict[int, list[int]]]:
    """Positions of each mask, then those of whole shorter items, and by number of words which of the latter count.

    Where m words may differ, the inner words are cut into m + 1 parts: one of them is equal, and each pattern looks at one.
    """
    used = masks(least, alike)
    looks, whole = [np.flatnonzero([c == "1" for c in m]) for m in used], {}
    for n in range(1, SPAN if used == MASKS else least):
        parts = int(n * (1 - exact(alike))) + 1 if n >= LEAST_WORDS else 1
        inner = np.arange(1, n - 1)
        kept = [[0, *inner[(inner - 1) * parts // max(1, n - 2) == x].tolist(), n - 1] for x in range(parts)]
        whole[n] = list(range(len(looks), len(looks) + parts))
        looks += [np.unique(x) for x in kept]
    return looks, whole


def masked(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash under pattern k, which looks at the words `at`, of the run that starts at each place."""
    n = len(values) - int(at[-1])
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(k + 1))
    for p in at:
        total = mixed_step(total, values[p:p + n])
    return mixed(total)


def mixed_step(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (total ^ word) * np.uint64(0x9FB21C651E98DF25) + (word >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _seeds(items: DataFrame, least: int, alike: float) -> DataFrame:
    """(item, words, seeds) of every test item; a seed is (k, at, h)."""
    (looks, whole), first = patterns(least, alike), len(masks(least, alike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for b in batches:
            for i in range(b.num_rows):
                found = tokens(b.column(1)[i].as_py())
                values = np.array([memo[w] for w in found], dtype=np.uint64)
                n = len(values)
                kinds = whole.get(n, range(first)) if n >= LEAST_WORDS or sum(map(len, found)) >= LEAST_CHARS else []
                seeds = [{"k": k, "at": at, "h": int(h)} for k in kinds
                         for at, h in enumerate(masked(values, looks[k], k).view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([values.view(np.int64)], pa.list_(pa.int64())),
                     pa.array([seeds], pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])))],
                    ["item", "words", "seeds"])
    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, words array<bigint>, seeds array<struct<k:int,at:int,h:bigint>>")


def _field(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit field of all seed hashes, two bits each: 2^bits bits whatever the number of test items."""
    high, low = F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    slot = F.explode(F.array(high, low))
    parts = (seeds.select(slot.alias("slot"))
             .groupBy(F.floor(F.col("slot") / 32768).cast("int").alias("part"))
             .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bits")))
    field = np.zeros(1 << bits, dtype=bool)
    for part, data in parts.toLocalIterator():  # 2^bits / 8 bytes in all
        field[part << 15:(part + 1) << 15] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
    return np.packbits(field, bitorder="little")


def _joined(at: np.ndarray, least: int, alike: float) -> list[tuple[int, int]]:
    """Hits at the places `at` of one text, as index ranges (from, to) that no stretch that counts can join any more."""
    out: list[tuple[int, int]] = []
    breaks = (np.flatnonzero(np.diff(at) > 2 * reach(SPAN, least, alike) + SPAN) + 1).tolist()
    for a, z in zip([0, *breaks], [*breaks, len(at)]):
        while out and at[a] <= (end := at[out[-1][1] - 1] + SPAN) + reach(int(end - at[out[-1][0]]), least, alike) \
                + reach(int(at[z - 1] + SPAN - at[a]), least, alike):
            a = out.pop()[0]
        out.append((a, z))
    return out


def _regions(docs: DataFrame, field, kinds: list[int], bits: int, least: int, alike: float) -> DataFrame:
    """Stretches of documents around possible hits: (key, h1, start, words, hits); hits are (k, at, h), `at` in the text.

    A stretch is wide enough for every overlap that holds one of its hits.
    """
    looks, _ = patterns(least, alike)
    hit = pa.struct([("k", pa.int32()), ("at", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held = Tokens(), np.unpackbits(field.value, bitorder="little").astype(bool)
        for b in batches:
            rows = ((i, tokens(t.as_py())) for i, t in enumerate(b.column(2)))
            for part in groups(rows, lambda x: len(x[1]), CHUNK_WORDS):
                values = np.array([memo[w] for _, d in part for w in d], dtype=np.uint64)
                ends = np.cumsum([len(d) for _, d in part])
                left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(values))
                at, k, h = [], [], []
                for kind in kinds:
                    hashes = masked(values, looks[kind], kind)
                    one, two = _slots(hashes, bits)
                    found = np.flatnonzero(held[one])
                    found = found[held[two[found]]]
                    found = found[left[found] > looks[kind][-1]]
                    at.append(found), h.append(hashes[found]), k.append(np.full(len(found), kind))
                at, k, h = np.concatenate(at), np.concatenate(k), np.concatenate(h)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, k, h = at[order], k[order], h[order].view(np.int64)
                doc = np.searchsorted(ends, at, side="right")
                edges = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(at)]
                out = {c: [] for c in ("row", "start", "words", "hits")}
                for a, z in ((x + i, x + j) for x, y in zip(edges, edges[1:]) for i, j in _joined(at[x:y], least, alike)):
                    begin, wide = ends[doc[a]] - len(part[doc[a]][1]), reach(int(at[z - 1] + SPAN - at[a]), least, alike)
                    low, top = max(begin, at[a] - wide), min(ends[doc[a]], at[z - 1] + SPAN + wide)
                    out["row"].append(part[doc[a]][0])
                    out["start"].append(int(low - begin))
                    out["words"].append(values[low:top].view(np.int64))
                    out["hits"].append([{"k": int(k[x]), "at": int(at[x] - begin), "h": int(h[x])} for x in range(a, z)])
                take = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(out["start"], pa.int32()),
                     pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["hits"], pa.list_(hit))],
                    ["key", "h1", "start", "words", "hits"])
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, h1 bigint, start int, words array<bigint>, "
                                "hits array<struct<k:int,at:int,h:bigint>>")


def overlaps(same: np.ndarray, least: int, alike: float) -> list[tuple[int, int, int]]:
    """Every stretch (from, to, equal words) of at least `least` words that starts and ends alike and of whose words a share
    `alike` or more is equal, unless it lies within another one.

    Sums of 1 - alike per equal word and -alike per other, as whole numbers, tell the share of any stretch; the furthest start
    for an end is the first one whose sum is not above the end's.
    """
    part = exact(alike)
    sums = np.concatenate([[0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))])
    at = np.flatnonzero(same)
    begin = at[np.searchsorted(-np.minimum.accumulate(sums[at]), -sums[at + 1])]
    right = np.append(np.minimum.accumulate(begin[::-1])[::-1][1:], len(same))  # least start of the ends further on
    whole = (begin < right) & (at + 1 - begin >= least)
    return [(a, z, int(same[a:z].sum())) for a, z in zip(begin[whole].tolist(), (at[whole] + 1).tolist())]


def _verified(pairs: DataFrame, least: int, alike: float) -> DataFrame:
    """Overlaps (key, h1, item, start, end, equal) of each region, item and diagonal; places count words of the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, spans = [], []
            for i in range(b.num_rows):
                start, diagonal = b.column(3)[i].as_py(), b.column(4)[i].as_py()
                region, item = (b.column(c)[i].values.to_numpy() for c in (5, 6))
                low, top = max(start, diagonal), min(start + len(region), diagonal + len(item))
                same = region[low - start:top - start] == item[low - diagonal:top - diagonal]
                for a, z, equal in overlaps(same, min(least, len(item)), alike):
                    rows.append(i)
                    spans.append((low + a, low + z, equal))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in range(3)), *(pa.array([s[c] for s in spans], pa.int32()) for c in range(3))],
                ["key", "h1", "item", "start", "end", "equal"])
    key, item = (pairs.schema[c].dataType.simpleString() for c in ("key", "item"))
    return pairs.mapInArrow(run, f"key {key}, h1 bigint, item {item}, start int, end int, equal int")


def benchmark_overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                       item: str = "item_id", item_text: str = "text", least: int = 13, alike: float = 0.8,
                       field_bits: int = FIELD_BITS) -> DataFrame:
    """(key, h1, item, start, end, equal): every stretch of a document that repeats a test item; h1 is the text's hash.

    A stretch has at least `least` words (or all of a shorter item), of which a share `alike` (above 0) equals the item's,
    starting and ending alike; one within another of the same item and diagonal is not reported. Places count the document's
    words. Null and empty texts have none, items under five words count
    if they are equal throughout and have LEAST_CHARS characters, equal items each report, repeated rows report once, rows without a key report under a null key, and an
    empty table on either side gives no rows. Columns beyond the named ones are ignored.
    """
    spark = docs.sparkSession
    tests = written(_seeds(own_names(items, item, item_text).toDF("item", "text"), least, alike))
    seeds = tests.select("item", F.explode("seeds").alias("s")).select("item", "s.k", F.col("s.at").alias("item_at"), "s.h")
    kinds = sorted(r[0] for r in seeds.select("k").distinct().collect())  # at most one per pattern
    field = spark.sparkContext.broadcast(_field(seeds, field_bits))
    rows = own_names(docs, key, text).toDF("key", "text").select("key", F.xxhash64("text").alias("h1"), "text")
    found = _regions(rows, field, kinds or [0], field_bits, least, alike)
    regions = written(found.dropDuplicates(["key", "h1", "start"]))
    hits = (regions.select("key", "h1", "start", F.explode("hits").alias("s"))
            .select("key", "h1", "start", "s.k", "s.at", "s.h"))
    met = (hits.join(seeds, ["k", "h"])
           .select("key", "h1", "start", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    at = regions.select("key", "h1", "start", F.col("words").alias("region"))
    same_row = met["key"].eqNullSafe(at["key"]) & (met["h1"] == at["h1"]) & (met["start"] == at["start"])
    placed = met.join(at, same_row).select(met["key"], met["h1"], "item", met["start"], "diagonal", "region")
    pairs = (placed.join(tests.select(F.col("item").alias("_item"), "words").dropDuplicates(["_item", "words"]),
                         F.col("item").eqNullSafe(F.col("_item")))
             .select("key", "h1", "item", "start", "diagonal", "region", "words"))
    return _verified(pairs, least, alike).distinct()
