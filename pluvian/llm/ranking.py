"""Ranked lexical search by bag deduplication.

A document counts for a search only by the terms that some item has and by its length. So every document is cut down to its
term counts over the items' vocabulary, and to m, the length that scores see. Documents with the same counts and the same m form
a class: classes are scored once for all items, and only the classes at the top of an item are expanded to their documents.

Scores are sums of w * ((10^9 * tf) div (1000 * tf + 20 * m)) over an item's terms, all in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names
from pluvian.session import written

#: ASCII letters and digits and everything beyond ASCII make terms; A-Z count as a-z.
FOLDED = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Terms times items that are searched for at once (one item may have more); more items are searched in blocks.
BLOCK_CELLS = 1 << 23
#: Numbers in an array of documents.
CELLS = 1 << 21
#: Sums below this are exact in doubles.
EXACT = 1 << 53
PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])
LAST = np.iinfo(np.int64).max


def terms(text: str | bytes | None) -> list[bytes]:
    """All terms in order; bytes beyond ASCII are parts of terms."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLDED).split()


@dataclass(frozen=True)
class Items:
    """A block of items: their places in the whole list, the sorted vocabulary, and the terms of each as numbers."""

    places: list[int]
    vocabulary: list[bytes]
    members: list[np.ndarray]


def blocks_of(texts: list[str | None]) -> Iterator[Items]:
    """Items in blocks of bounded size; one item alone may be larger."""
    part, vocabulary = [], set()
    for place, text in enumerate(texts):
        found = set(terms(text))
        if part and (len(part) + 1) * len(vocabulary | found) > BLOCK_CELLS:
            yield _block(part, vocabulary)
            part, vocabulary = [], set()
        part.append((place, found))
        vocabulary |= found
    if part:
        yield _block(part, vocabulary)


def _block(part: list[tuple[int, set[bytes]]], terms_: set[bytes]) -> Items:
    vocabulary = sorted(terms_)
    number = {t: i for i, t in enumerate(vocabulary)}
    return Items([p for p, _ in part], vocabulary, [np.array(sorted(number[x] for x in t), dtype=np.int64) for _, t in part])


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """(key, n, bag): the number of all terms, and the counts of those in the vocabulary as sorted pairs (term, tf)."""
    held = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded by BLOCK_CELLS, or the terms of one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(held.value)}
        for b in batches:
            sizes, packed = [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                found = terms(raw)
                sizes.append(len(found))
                seen = Counter(map(number.get, found))
                seen.pop(None, None)
                packed.append(np.array(sorted(seen.items()), dtype=PAIR).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["key", "n", "bag"])
    return docs.mapInArrow(run, "key bigint, n bigint, bag binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term of the vocabulary; every task adds up its own documents first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total[np.frombuffer(raw, PAIR)["term"]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["term", "n"])
    out = np.zeros(size, dtype=np.int64)
    for term, n in found.select("bag").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)


class Scorer:
    """Scores of many bags against all items of a block: a matrix product, in doubles where all sums are exact in them."""

    def __init__(self, items: Items, w: np.ndarray) -> None:
        self.w, self.members = w, items.members
        most = max((int(w[t].sum()) for t in items.members), default=0)
        self.type = np.float64 if most * 1_000_000 < EXACT else np.int64  # a term's factor is below 10^6
        self.matrix = np.zeros((len(items.vocabulary), len(items.members)), dtype=self.type)
        for k, t in enumerate(items.members):
            self.matrix[t, k] = 1
        self.rows = max(1, CELLS // max(1, len(items.vocabulary), len(items.members)))

    def scores(self, found: list[bytes], m: np.ndarray) -> np.ndarray:
        """len(found) x items."""
        pairs = np.frombuffer(b"".join(found), PAIR)
        row = np.repeat(np.arange(len(found)), [len(x) // PAIR.itemsize for x in found])
        tf = pairs["tf"].astype(np.int64)
        dense = np.zeros((len(found), len(self.w)), dtype=self.type)
        dense[row, pairs["term"]] = self.w[pairs["term"]] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        return (dense @ self.matrix).astype(np.int64)


def best_classes(classes: DataFrame, items: Items, w: np.ndarray, k: int) -> DataFrame:
    """(item, class, size, first, score): per item the k classes of highest score above 0 of every task, ties by first document.

    The best k documents of an item lie in its best k classes in that order: every class before a document's own holds
    a document that comes before it.
    """
    held = classes.sparkSession.sparkContext.broadcast((items, w))
    names = ["item", "class", "size", "first", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = held.value
        scorer = Scorer(items, w)
        best = [np.zeros((0, 4), dtype=np.int64) for _ in items.members]  # -score, first, class, size
        for b in batches:
            for at in range(0, b.num_rows, scorer.rows):
                rows = b.slice(at, scorer.rows)
                number, m, size = (rows.column(c).to_numpy() for c in (0, 2, 3))
                first = rows.column(4).fill_null(LAST).to_numpy()
                score = scorer.scores(rows.column(1).to_pylist(), m)
                for i in np.flatnonzero(score.any(axis=0)):
                    s = score[:, i]
                    floor = max(1, -best[i][k - 1, 0]) if len(best[i]) == k else 1
                    some = np.flatnonzero(s >= floor)
                    if len(some):
                        new = np.stack([-s[some], first[some], number[some], size[some]], axis=1)
                        all_ = np.concatenate([best[i], new])
                        best[i] = all_[np.lexsort((all_[:, 1], all_[:, 0]))[:k]]
        for i, rows in enumerate(best):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(rows), i, np.int32), rows[:, 2], rows[:, 3], rows[:, 1], -rows[:, 0])], names)
    return classes.select("class", "bag", "m", "size", "first").mapInArrow(run, "item int, class bigint, size bigint, first bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents of every item with a score above 0, equal scores by ascending key.

    Keys are integers. Items are the query set, gathered on the driver; documents only ever as classes on the executors. Null and empty texts have no
    terms: such a document ranks nowhere, such an item gets no rows. Repeated documents are ranked each for itself (null
    keys last; equal keys of one score look alike); repeated items are answered each. An empty table on
    either side gives no rows. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    asked = own_names(items, item, item_text)
    queries = asked.collect()
    out = None
    for block in blocks_of([q[1] for q in queries]):
        part = _searched(own_names(docs, key, text).toDF("key", "text").withColumn("key", F.col("key").cast("bigint")), block, k)
        out = part if out is None else out.unionByName(part)
    kind = asked.schema[0].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` bigint, score bigint")
    named = spark.createDataFrame([(i, q[0]) for i, q in enumerate(queries)], f"item int, name {kind}")
    return out.join(named, "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")


def _searched(docs: DataFrame, items: Items, k: int) -> DataFrame:
    found = written(bags(docs, items))
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = weights(document_frequencies(found, len(items.vocabulary)), n_docs)
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    held = found.where(F.length("bag") > 0).withColumn("m", m)  # without a term of the items every score is 0
    # equal hashes are verified: the bags themselves are keys too and are compared byte by byte
    alike = held.withColumn("h", F.xxhash64("bag", "m"))
    classes = written(alike.groupBy("h", "bag", "m").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first"))
                      .withColumn("class", F.monotonically_increasing_id()))
    top = best_classes(classes, items, w, k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first"))
    better = Window.partitionBy("item").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, -1)
    best = written(top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                   .withColumn("better", F.coalesce(F.sum("size").over(better), F.lit(0)))
                   .where(F.col("better") < k).select("item", "class", "score"))  # at most k rows an item
    # the documents of the wanted classes; of each class only its first k can be ranked
    wanted = classes.join(best.select("class").distinct(), "class").select("h", "bag", "m", "class")
    inside = Window.partitionBy("class").orderBy(F.col("key").asc_nulls_last())
    members = (alike.join(wanted, ["h", "bag", "m"]).select("class", "key")
               .withColumn("n", F.row_number().over(inside)).where(F.col("n") <= k).drop("n"))
    final = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = best.join(members, "class").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    place = F.element_at(F.array(*[F.lit(p) for p in items.places]), F.col("item") + 1)
    return ranked.select(place.alias("item"), "rank", "key", "score")
