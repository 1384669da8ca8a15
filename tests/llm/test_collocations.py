"""Collocations against plain counting, and filters as exact round trips."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pluvian.llm import collocations as c
from tests.llm import brute


def found(spark, docs, **more):
    df = spark.createDataFrame([(t, x, 1, 2) for x, t in docs], "text string, lang string, n int, phrase int")
    rows = c.collocations(df, **more).collect()
    out = brute.groups((r["lang"], (r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])) for r in rows)
    return {k: sorted(v) for k, v in out.items()}


def texts(n, seed=1):
    rng = random.Random(seed)
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; ", "\x0b"]
    words = ["New", "new", "york", "YORK", "rain", "a", "b", "a\x01", "é", "日本", "\xa0", "x-y", "\x1c"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("top", [5, 2000])
def test_against_plain_counting(spark, top):
    docs = texts(150) + [("en", "new york city " * 12), ("en", None), ("de", ""), ("xx", "one two three")]
    want = brute.phrases(docs, top=top)
    assert found(spark, docs, top=top) == want and {"en", "de", "und"} <= set(want)
    assert all(len(v) <= top for v in want.values())


def test_small_blocks_and_filters(spark, monkeypatch):
    """Texts cut into many slices, blocks, parts, filters and segments count the same."""
    monkeypatch.setattr(c, "SEGMENT", 16)
    docs = texts(200, 7) + [("en", "rain a b. " * 400)]
    # tasks import the module anew; the numbers they use are passed by running their functions here
    for name, value in (("BLOCK_WORDS", 50), ("SLICE_BYTES", 64), ("FRESH", 7), ("HELD", 20)):
        monkeypatch.setattr(c, name, value)
    words = c.Words()
    assert b"".join(c.slices(b"ab\ncd" * 100)) == b"ab\ncd" * 100
    whole, cut = c.Words(), c.Words()
    text = ("rain a b. " * 400).encode().translate(c.FOLDED)
    whole.add(text)
    for part in c.slices(text):
        cut.add(part)
    assert words.found == [] and whole.found == cut.found and np.array_equal(whole.row()[1], cut.row()[1])
    assert found(spark, docs, least=3) == brute.phrases(docs, least=3)


def test_no_phrase_at_all(spark):
    assert found(spark, [("en", "a b c"), ("de", None)]) == {}
    assert found(spark, [("en", "word. " * 50)]) == {}
    assert c.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_very_long_text(spark):
    docs = [("en", "the rain, in spain " * 60000), ("en", "rain in")]
    assert found(spark, docs) == brute.phrases(docs)


@pytest.mark.parametrize("bits", [1, 3, 19, 21, 22, 32])
def test_permutation_is_inverted(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, 1000).astype(np.uint64) for _ in range(3)]
    layout = c.Layout(bits, 0)
    hi, lo = layout.pack(*ids)
    assert int(hi.max()) < 1 << bits and int(lo.max()) < 1 << 2 * bits
    assert all(np.array_equal(a, b) for a, b in zip(layout.unpack(hi, lo), ids))
    if bits == 3:
        every = np.arange(1 << 9, dtype=np.uint64)
        hi, lo = layout.turned(every >> np.uint64(6), every & np.uint64(63))
        assert len(set(zip(hi.tolist(), lo.tolist()))) == 1 << 9


@pytest.mark.parametrize("bits,segment_bits,n", [(1, 0, 2), (3, 2, 200), (12, 4, 5000), (21, 6, 5000), (27, 5, 5000), (32, 8, 5000), (20, 20, 300)])
def test_filters_lose_nothing(bits, segment_bits, n):
    rng = np.random.default_rng(n)
    layout = c.Layout(bits, segment_bits)
    ids = [(rng.integers(0, 1 << bits, n) // rng.choice([1, 1 << bits // 2], n)).astype(np.uint64) for _ in range(3)]
    counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], n)
    want = {}
    for *key, k in zip(*(x.tolist() for x in ids), counts.tolist()):
        want[tuple(key)] = want.get(tuple(key), 0) + k
    half = n // 2
    parts = {}
    for s in (slice(0, half), slice(half, n)):
        entries = layout.folded(*layout.pack(*(x[s] for x in ids)), counts[s])
        for number, packed in layout.segments(entries):
            parts.setdefault(number, []).append(layout.segment(number, packed))
    got = {}
    for number, held in parts.items():
        hi, lo, k = layout.folded(*(np.concatenate(x) for x in zip(*held)))
        for *key, size in zip(*(x.tolist() for x in layout.unpack(hi, lo)), k.tolist()):
            assert tuple(key) not in got
            got[tuple(key)] = size
    assert got == want and max(parts) < 1 << segment_bits


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10 ** 12, 10 ** 12, 10 ** 12), (10 ** 12 - 1, 10 ** 12, 10 ** 12), (3, 7, 5)], "n bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(c.association(*[df[x] for x in "nlr"])).collect()]
    assert got == [10 ** 6, 10 ** 6 * (10 ** 12 - 1) ** 2 // 10 ** 24, 9 * 10 ** 6 // 35]


def test_room_of_a_task(monkeypatch):
    """Filters are filled and merged slice by slice: the room is little more than that of the entries held."""
    for name, value in (("FRESH", 1 << 15), ("HELD", 1 << 19)):
        monkeypatch.setattr(c, name, value)

    class Frame:
        def __getattr__(self, _):
            return lambda *a: self if isinstance(a[0], str) else a[0]
    words, rng, layout = 50_000, np.random.default_rng(3), c.Layout(16, 0)
    codes = [rng.integers(0, words, 1 << 15).astype(np.int32) for _ in range(12)]
    for x in codes:
        x[0] = words - 1
    rows = pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(x.tobytes()) for x in codes]),
                                       pa.array([range(1, words)] * 12, pa.list_(pa.int32())), pa.array([range(1, words)] * 12, pa.list_(pa.int64()))], list("xyz"))
    tracemalloc.start()
    filters = [f for b in c.phrase_filters(Frame(), layout)(iter([rows])) for f in b["filter"]]
    filled = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found = c.merged(Frame(), layout, 1)((pa.scalar(0),), pa.table([filters], names=["filter"]))
    room = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(int(((x[:-1] > 0) & (x[1:] > 0)).sum() + ((x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)).sum()) for x in codes)
    assert sum(found["n"].to_pylist()) == n and found.num_rows > c.HELD
    assert filled < 50 * c.HELD and room < 100 * found.num_rows, (filled / c.HELD, room / found.num_rows)
