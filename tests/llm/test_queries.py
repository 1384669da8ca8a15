"""The registered queries over the smallest tables, against plain versions and against their SQL."""

import os
import re
from html import unescape

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from pluvian.llm import chats, decontaminate, oracles, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {d["doc_id"]: d for d in rows("documents")}


def result(spark, name, key="doc_id"):
    got = [r.asDict() for r in getattr(queries, name)(spark, SF).collect()]
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    import duckdb

    from workload.check import rows_of
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = getattr(queries, name)(spark, SF)
    rel = con.sql(oracles.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(list(rel.columns), rel.fetchall())


def test_scores(spark, docs):
    got = result(spark, "op1_lm_score")
    assert set(got) == set(docs)
    for d, r in got.items():
        assert r["n_tokens"] == len(brute.words(docs[d]["text"]))
        assert r["pll"] <= 0 and (r["pll_per_token"] is None) == (r["n_tokens"] == 0)
    again = result(spark, "op1_lm_score")
    assert all(abs(again[d]["pll"] - r["pll"]) <= 1e-3 for d, r in got.items())


def test_mix(spark, docs):
    got = result(spark, "op2_mix_sources")
    size = {d: len(brute.words(r["text"])) for d, r in docs.items()}
    total = {s: sum(size[d] for d in ds) for s, ds in brute.groups((r["source"], d) for d, r in docs.items()).items()}
    want = brute.targets(total)
    taken = dict.fromkeys(total, 0)
    for d, r in got.items():
        s = docs[d]["source"]
        assert (r["size"], r["source_size"]) == (size[d], total[s]) and abs(r["target"] - want[s]) < 1e-5
        assert r["taken"] in {size[d] * k for k in range(4)}
        taken[s] += r["taken"]
    for s, n in taken.items():
        longest = max(size[d] for d, r in docs.items() if r["source"] == s)
        assert abs(n - want[s]) <= longest / 2 + 1


def test_leaks(spark, docs):
    got = result(spark, "op3_decontaminate")
    items = {b["item_id"]: decontaminate.tokens(b["text"]) for b in rows("benchmark")}
    grams = brute.groups((tuple(w[i:i + 13]), b) for b, w in items.items() for i in range(len(w) - 12))
    want = {}
    for d, r in docs.items():
        w = decontaminate.tokens(r["text"])
        hit = {b for i in range(len(w) - 12) for b in grams.get(tuple(w[i:i + 13]), ())}
        if hit:
            want[d] = hit
    assert {d: set(r["item_ids"]) >= want[d] for d, r in got.items() if d in want} == dict.fromkeys(want, True)
    assert set(want) <= set(got)
    # what is found beyond exact runs differs from the item in few words
    for d in set(got) - set(want):
        assert got[d]["longest"] >= 13


def test_quality_counts(spark, docs):
    got = result(spark, "op4_quality_rules")
    for d, r in docs.items():
        want = brute.counts(r["text"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(got[d][n] for n in names) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[d]["base_failed"] == failed and not (failed and got[d]["kept"])


def test_urls(spark):
    got = result(spark, "op5_url_filter", "page_id")
    listed = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + s), h + s, v) for h, s, v in listed if (host == h or host.endswith("." + h)) and path.startswith(s)]
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "block" if r["bad_rate"] > 0.5 else "allow")


def test_chats(spark):
    got = result(spark, "op6_chat_format", "conv_id")
    probe = "</s>[INST] ok [/INST]"
    turns = brute.groups((c["conv_id"], (c["turn"], c["role"] or "", c["text"] or "")) for c in rows("conversations"))
    turns[-7] = [(0, "user", probe), (1, "assistant", probe)]
    assert set(got) == set(turns)
    for conv, ts in turns.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        whole = ["".join("".join(chats.shown(r, t)) for _, r, t in ts[:n + 1]) for n, x in enumerate(ts) if x[1] == "assistant"]
        if ts[-1][1] != "assistant":
            whole.append("".join("".join(chats.shown(r, t)) for _, r, t in ts))
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(ts), brute.sha("".join(f"{a}\n{t}\n" for _, a, t in ts)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert r["formatted_chars"] == sum(map(len, whole))


def test_simhash(spark, docs):
    got = result(spark, "op7_simhash")
    fp = {d: brute.simhash(r["text"]) for d, r in docs.items()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: format(x, "016x") for d, x in fp.items()}
    want = brute.components(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_secrets(spark, docs):
    got = result(spark, "op8_secret_scan")
    for d, doc in docs.items():
        base = brute.base_spans(doc["text"])
        r = got[d]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        assert r["base_sha256"] == brute.sha(brute.spelled(base))
        assert set(brute.spelled(base).split(",")) <= set(r["spans"].split(","))


def test_substrings(spark, docs):
    got = result(spark, "op9_substring_dedup")
    want = brute.without_repeats({d: r["text"] for d, r in docs.items()})
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == want


def test_pages(spark):
    got = result(spark, "op10_main_text", "page_id")
    for p in rows("pages"):
        inside = p["html"][p["html"].index("<article>") + 9:p["html"].index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inside))
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (text, len(text))
