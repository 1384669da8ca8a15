"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are cut into tiles of one population count each. Two tiles meet only if their counts differ by at
most the radius; inside a meeting, rows ordered by the population count of their upper half skip the columns that the
radius rules out. What is left is compared exactly, by exclusive-or and bit count in numpy. A meeting returns a spanning
forest of its links, never the links themselves, so a group of many near copies costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.llm.columns import identity, own_names, with_row
from pluvian.llm.components import connected
from pluvian.session import written

TILE = 8192
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is space and \t to \r
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    begins = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(begins, ends[shingle - 1:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, fp) of every document; fp is the fingerprint as a signed 64-bit number."""
    rows = own_names(docs, key, text).toDF("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def hang(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u[i] and v[i]; afterwards every parent is the smallest member of its set."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def meeting(a: np.ndarray, b: np.ndarray, radius: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (or inside one, `a is b`) as (member, root) fingerprints."""
    same = a is b
    high = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int16)
    a = a[np.argsort(high(a), kind="stable")]
    b = a if same else b[np.argsort(high(b), kind="stable")]
    ha, hb = high(a), high(b)
    # |dh| + |d - dh| <= radius for the difference d of the counts and dh of the upper halves
    d = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0])) if len(a) and len(b) else 0
    low, top = -((radius - d) // 2), (radius + d) // 2
    offset = 0 if same else len(a)
    parent = np.arange(offset + len(b))
    for at in range(0, len(a), block):
        rows = a[at:at + block]
        first = np.searchsorted(hb, ha[at] + low)
        last = np.searchsorted(hb, ha[at + len(rows) - 1] + top, side="right")
        if first >= last:
            continue
        near = np.bitwise_count(rows[:, None] ^ b[None, first:last]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            hang(parent, i + at, j + first + offset)
    nodes = a if same else np.concatenate([a, b])
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return nodes[child], nodes[parent[child]]


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect what the distinct fingerprints `fp` within `radius` bits connect, repeats possible."""
    bits = F.bit_count("fp").cast("int")
    sizes = prints.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65 rows
    parts = F.lit(1)
    for b, n in sizes:
        parts = F.when(F.col("bits") == b, F.lit(-(-n // tile))).otherwise(parts)
    cut = (prints.select("fp", bits.alias("bits"))
           .select("fp", "bits", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part")))
    # a tile has about `tile` fingerprints, by the hash, so the list is bounded
    tiles = written(cut.groupBy("bits", "part").agg(F.collect_list("fp").alias("fps"))
                    .withColumn("id", F.col("bits").cast("bigint") * F.lit(1 << 40) + F.col("part")))
    one = tiles.select(F.col("id").alias("a"), F.explode(F.sequence("bits", F.col("bits") + radius)).alias("bits"))
    two = tiles.select("bits", F.col("id").alias("b"))
    pairs = one.join(two, "bits").where(F.col("a") <= F.col("b")).select("a", "b")
    met = (pairs.join(tiles.select(F.col("id").alias("a"), F.col("fps").alias("fps_a")), "a")
           .join(tiles.select(F.col("id").alias("b"), F.col("fps").alias("fps_b")), "b")
           .select((F.col("a") == F.col("b")).alias("same"), "fps_a", "fps_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 2))
                child, root = meeting(a, a if batch.column(0)[k].as_py() else b, radius)
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))],
                                                     ["u", "v"])
    return met.mapInArrow(run, "u bigint, v bigint")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint: root names its component."""
    nodes = written(prints.select("fp").distinct())
    roots = connected(links(nodes, radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """(key, fp, component_id) of every document; component_id is the smallest key reachable over links of `radius` bits.

    Null and empty texts have fingerprint zero, which links like any other. Rows without a key keep their component, but
    never name it unless all its rows lack one (then null). Repeated rows, ties and equal fingerprints are one node. An
    empty table gives no rows. Columns beyond the named ones are ignored.
    """
    prints = written(fingerprints(docs, key, text, shingle))
    member = _grouped(prints, radius).join(prints.groupBy("fp").agg(F.min("key").alias("least")), "fp")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    group = member.join(named, "root").select("fp", "component_id")
    return prints.join(group, "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs` that stay when one document of every component does: that with the smallest key.

    Rows with a key go before those without; among equal keys the text's hash decides, and of rows that agree in both one
    stays. All columns of `docs` are returned, whatever their names.
    """
    rows = with_row(docs, key, text).toDF("_row", "key", "text").withColumn("h1", F.xxhash64("text"))
    rows = rows.withColumn("id", identity(F.col("key"), F.col("h1")))
    known = rows.select(F.struct("key", "h1", "id").alias("k"), "text")
    prints = written(fingerprints(known, "k", "text", shingle)).select("key.*", "fp")
    order = F.struct(F.col("key").isNull(), "key", "h1")
    first = (prints.join(_grouped(prints, radius), "fp").groupBy("root")
             .agg(F.min_by(F.struct("id", "h1"), order).alias("k")).select("k.*"))
    return rows.join(first, ["id", "h1"], "left_semi").dropDuplicates(["id", "h1"]).select("_row.*")
