"""Ranked search against a plain version that scores every document for every item."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from pluvian.llm import queries, ranking
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def ranked(rows, item="item_id", key="doc_id"):
    out = brute.groups((r[item], (r["rank"], r[key], r["score"])) for r in rows)
    return {k: sorted(v) for k, v in out.items()}


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    want = brute.best_matches([(d["doc_id"], d["text"]) for d in docs], [(b["item_id"], b["text"]) for b in items])
    assert ranked(queries.op12_ranked_search(spark, SF).collect()) == {items[i]["item_id"]: r for i, r in want.items() if r}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def both(spark, docs, items, k=50):
    """docs: [(key, text)], items: [(name, text)], all names different."""
    d = frame(spark, [(t, x, "clash") for x, t in docs], "text string, doc_id bigint, item_id string")
    i = frame(spark, [(n, t, 1) for n, t in items], "item_id string, text string, doc_id int")
    got = ranked(ranking.search(d, i, k).collect())
    want = {items[p][0]: r for p, r in brute.best_matches(docs, items, k).items() if r}
    assert got == want
    return got


def test_ties_copies_and_classes(spark):
    rng = random.Random(2)
    vocabulary = ["rain", "river", "Ümlaut", "flood", "x9", "gauge"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 6))) for _ in range(60)]
    # reordered words and other unknown words of the same number make one class; 200 copies of one text; ties across classes
    docs = [(i, rng.choice(base) + rng.choice([" foo", " bar", "; BAZ"])) for i in rng.sample(range(10 ** 6), 500)]
    docs += [(10 ** 7 + i, "rain river rain") for i in range(200)] + [(-5, "RIVER, rain rain"), (-5, "rain river rain"), (None, "rain rain river")]
    items = [("one", "rain"), ("two", "River rain. rain"), ("all", " ".join(vocabulary)), ("unknown", "zebra"), ("empty", ""), ("null", None),
             ("again", "rain")]
    for k in (1, 7, 50):
        got = both(spark, docs, items, k)
        assert got["one"] == got["again"] and not {"unknown", "empty", "null"} & set(got)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "\x00\x1f .,;"), (4, "a" * 100000 + " b"), (5, "b " * 50000 + "Straße ſ K"), (6, "日本語 日本"), (7, "STRAßE b")]
    both(spark, docs, [("a", "straße B"), ("b", "日本語"), ("c", "K ſ k"), ("d", "a" * 100000)])
    both(spark, [(1, None), (2, "..")], [("a", "x")])


def test_empty_tables(spark):
    docs, items = "doc_id bigint, text string", "item_id int, text string"
    assert ranking.search(frame(spark, [], docs), frame(spark, [(1, "a")], items)).collect() == []
    none = ranking.search(frame(spark, [(1, "a")], docs), frame(spark, [], items))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_CELLS", 6)
    texts = ["a b", "b c", "c d e f g h i j", "a", None, "j"]
    cut = list(ranking.blocks_of(texts))
    assert [p for b in cut for p in b.places] == list(range(6)) and len(cut) > 2
    docs = [(i, t) for i, t in enumerate(["a b c", "j j i", "d e", "c", "b b b"])]
    both(spark, docs, [(f"i{k}", t) for k, t in enumerate(texts)], 2)


@pytest.mark.parametrize("exact", [1, 1 << 53])
def test_scores_are_the_same_in_integers(monkeypatch, exact):
    monkeypatch.setattr(ranking, "EXACT", exact)
    rng = np.random.default_rng(3)
    items = next(ranking.blocks_of([" ".join(f"t{x}" for x in rng.integers(0, 40, 12)) for _ in range(9)]))
    w = rng.integers(0, 20000, len(items.vocabulary))
    bags, m = [], rng.integers(50, 10 ** 6, 30)
    for _ in m:
        t = np.flatnonzero(rng.random(len(w)) < 0.3)
        bags.append(np.array(list(zip(t, rng.integers(1, 10 ** 6, len(t)))), dtype=ranking.PAIR))
    got = ranking.Scorer(items, w).scores([b.tobytes() for b in bags], m)
    for d, (b, mm) in enumerate(zip(bags, m.tolist())):
        for i, members in enumerate(items.members):
            held = set(members.tolist())
            assert got[d, i] == sum(int(w[t]) * (10 ** 9 * int(f) // (1000 * int(f) + 20 * mm)) for t, f in b.tolist() if t in held)
