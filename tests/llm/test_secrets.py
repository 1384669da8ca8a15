"""The battery against a plain version, keys of every alphabet, and texts with very many matches."""

import math
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from pluvian.llm import secrets
from pluvian.llm.columns import running
from tests.llm import brute


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.digits + string.ascii_lowercase,
             "BASE36": string.digits + string.ascii_uppercase, "base62": string.digits + string.ascii_letters, "base64": string.ascii_letters + string.digits + "+/",
             "base64url": string.ascii_letters + string.digits + "-_"}


def test_battery_equals_the_plain_version(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(a, k=n)) for a in ALPHABETS.values() for n in (20, 33, 64, 200, 1000)]
    texts += ["a1" * 30, "abcdefghij0123456789" * 4, "A" * 40 + "1", "no digits here at all", "12345678901234567890123", "x9" + "é" * 30,
              f"two {'Zz9' * 9}, {'q8w7e6r5t4y3u2i1o0pa'}\U0001f600{'k3j4h5g6f7d8s9a0q1w2'}-", ""]
    got = texts_of(spark, texts).select("doc_id", secrets.candidates(F.col("text")).alias("c")).collect()
    seen = set()
    for r in got:
        want = brute.candidates(texts[r["doc_id"]])
        assert [(c["start"], c["end"], c["bin"]) for c in r["c"]] == [w[:3] for w in want], texts[r["doc_id"]]
        for c, w in zip(r["c"], want):
            assert c["p"] == pytest.approx(w[3], abs=2e-6)
        seen |= {w[2].split(":")[0] for w in want}
    assert seen == set(ALPHABETS)


def test_spans_equal_the_plain_version(spark):
    rng = random.Random(3)
    key = lambda a, n: "".join(rng.choices(ALPHABETS[a], k=n))
    texts = []
    for i in range(300):
        word = "".join(rng.choices("etaoinshrdlu", k=12)) + str(i % 10) + "".join(rng.choices("etaoin", k=12))
        texts.append(f"x {key(rng.choice(list(ALPHABETS)), rng.choice([24, 32, 40]))} {word} token={key('base62', 30)} {key('hex', 26)} AKIA{key('BASE36', 18)}")
    got = {r["doc_id"]: r for r in secrets.find_secrets(texts_of(spark, texts), ["doc_id"]).collect()}
    want = brute.all_spans(texts)
    assert {d: [tuple(s) for s in r["spans"]] for d, r in got.items()} == want
    assert any(k == 3 for spans in want.values() for _, k, _ in spans)


@pytest.mark.parametrize("alphabet", ["BASE36", "base62", "base36", "base64"])
def test_keys_are_found_at_the_false_discovery_rate(spark, alphabet):
    """300 random keys among as many made-up names with digits: most keys are found and few names."""
    rng = random.Random(1)
    keys = ["".join(rng.choices(ALPHABETS[alphabet], k=40)) for _ in range(300)]
    letters = sorted(set(ALPHABETS[alphabet]) & set("etaoinshETAOINSH"))[:8]
    names = ["".join(rng.choices(letters, k=18)) + f"{i % 7}" + "".join(rng.choices(letters, k=21)) for i in range(300)]
    found = {r["doc_id"] for r in secrets.find_secrets(texts_of(spark, [f"so {t}." for t in keys + names]), ["doc_id"]).collect()
             if any(s["rank"] == 3 for s in r["spans"])}
    caught, wrong = sum(d < 300 for d in found), sum(d >= 300 for d in found)
    assert caught > 0.85 * 300 and wrong <= 0.15 * len(found)


def test_time_grows_with_the_text(spark):
    """A hundred thousand matches in one text, and a token of a million characters."""
    rng = random.Random(2)
    sums = " ".join("%032x" % rng.getrandbits(128) for _ in range(100_000))
    token = "".join(rng.choices(ALPHABETS["base62"], k=1_000_000))
    names = " ".join(f"{x:x}Zq" + "xyz" * 7 for x in range(30_000))
    begin = time.time()
    got = {r["doc_id"]: r for r in secrets.find_secrets(texts_of(spark, [sums, token, f"{sums[:330_000]} {names}"]), ["doc_id"]).collect()}
    assert time.time() - begin < 120
    assert len(got[0]["base"]) == 100_000 and got[0]["base"][-1]["end"] == len(sums)
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] in ([(0, 1_000_000)], [])
    assert len(got[2]["base"]) == 10_000
    begin = time.time()
    masked = secrets.find_secrets(texts_of(spark, [sums]), ["text"]).select(secrets.redacted(F.col("text"), F.col("spans"), "#")).first()[0]
    assert masked == " ".join("#" * 1 for _ in range(100_000)) and time.time() - begin < 120


def test_running_sums_and_maxima(spark):
    rng = random.Random(5)
    lists = [[], [3], [rng.randint(-9, 9) for _ in range(64)], [rng.randint(-9, 9) for _ in range(65)], [rng.randint(-9, 9) for _ in range(1000)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = df.select("i", running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("s"), running(F.col("x"), F.greatest, F.lit(-99)).alias("m")).collect()
    for r in got:
        x = lists[r["i"]]
        assert r["s"] == [sum(x[:k + 1]) for k in range(len(x))] and r["m"] == [max(x[:k + 1]) for k in range(len(x))]


def test_overlapping_spans_are_masked_as_one(spark):
    rows = [("a\U0001f600bcdefgh", [(1, 3), (2, 4), (6, 7)]), ("abc", []), ("abc", [(0, 3)]), ("abcdef", [(0, 5), (1, 2), (3, 4)]), ("", [])]
    df = spark.createDataFrame([(t, [(a, 0, z) for a, z in s]) for t, s in rows], "t string, s array<struct<start:int,rank:int,end:int>>")
    assert [r[0] for r in df.select(secrets.redacted(F.col("t"), F.col("s"), "#")).collect()] == ["a#de#gh", "abc", "#", "#f", ""]
