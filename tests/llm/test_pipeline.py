"""The pipeline stage by stage, each against a plain version on what its predecessor kept."""

import os

import pytest

import corpus_pipeline as cp
from pluvian.llm import decontaminate as dc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def key(row):
    return tuple(sorted((k, repr(v)) for k, v in row.items()))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("start", [r.asDict() for r in docs.collect()])]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, [r.asDict() for r in docs.collect()]))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "simhash_dedup", "decontaminate", "secret_scan", "mix_sources"]
    for _, rows in stages[:5]:
        assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_rejects_the_base_failures(stages):
    before, after = stages[0][1], stages[1][1]

    def good(r):
        n, _, _, _, repeated = brute.counts(r["text"])
        return n >= 20 and 100 * repeated <= 30 * n
    # two hundred documents have too few labels to certify any cutoff
    assert sorted(map(key, after)) == sorted(key(r) for r in before if good(r))


def test_one_of_each_group_stays(stages):
    before, after = stages[1][1], stages[2][1]
    fp = {r["doc_id"]: brute.simhash(r["text"]) for r in before}
    group = brute.components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))


def test_leaks_go(stages):
    before, after = stages[2][1], stages[3][1]
    import pyarrow.parquet as pq
    items = [dc.tokens(b["text"]) for b in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    grams = {tuple(w[i:i + 13]) for w in items for i in range(len(w) - 12)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    leaks = {r["doc_id"] for r in before if any(tuple(w[i:i + 13]) in grams for w in [dc.tokens(r["text"])]
                                                for i in range(len(w) - 12))}
    assert leaks <= gone
    five = {tuple(w[i:i + 5]) for w in items for i in range(len(w) - 4)}
    for r in before:
        if r["doc_id"] in gone:
            w = dc.tokens(r["text"])
            assert any(tuple(w[i:i + 5]) in five for i in range(len(w) - 4))


def test_secrets_are_masked(stages):
    before, after = {r["doc_id"]: r for r in stages[3][1]}, {r["doc_id"]: r for r in stages[4][1]}
    assert set(before) == set(after)
    for d, r in before.items():
        spans, text, at = [], [], 0
        for a, _, z in brute.base_spans(r["text"]):
            if a >= at:
                text += [r["text"][at:a], "[SECRET]"]
                spans.append((a, z))
            at = max(at, z)
        text.append((r["text"] or "")[at:])
        assert after[d]["text"] == "".join(text)
        assert after[d]["n_chars"] == (len("".join(text)) if spans else r["n_chars"])


def test_mix_is_near_its_targets(stages):
    before, after = stages[4][1], stages[5][1]
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    total = {s: sum(size[d] for d in ds) for s, ds in brute.groups((s, d) for d, s in source.items()).items()}
    taken = dict.fromkeys(total, 0)
    for r in after:
        assert 1 <= r["copies"] <= 3
        taken[source[r["doc_id"]]] += r["copies"] * size[r["doc_id"]]
    for s, want in brute.targets(total).items():
        assert abs(taken[s] - want) <= max(size[d] for d in size if source[d] == s) / 2 + 1


def test_odd_rows_pass_every_stage(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names."""
    prose = " ".join(f"w{i}" for i in range(60))
    data = [(None, prose, "en", None, 1, "a"), (7, prose, None, "s", 2, "b"), (7, prose, None, "s", 2, "b"),
            (8, None, "en", "s", None, "c"), (9, "", "en", "s", 0, "d"),
            (10, prose.replace("w", "v") + ' token = "0123456789abcdef0123456789"', "en", "s", 3, "e")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string")
    docs = docs.withColumns({"key": docs.n_words, "h1": docs.n_words, "_row": docs.n_words, "copies_": docs.n_words})
    for _, stage in cp.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns
        docs = new
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {7, 10} and docs.count() == 2 and "[SECRET]" in got[10]["text"] and got[7]["text"] == prose
    assert cp.STAGES[-1][1](spark, docs, SF).count() <= 2
    empty = docs.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
