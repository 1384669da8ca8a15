"""Id files: exact round trips, and ids against whole texts given to the tokenizer."""

import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest

from pluvian.llm import idfiles, queries
from pluvian.session import fresh_path

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    return tokenizers.Tokenizer.from_file(vocabulary)


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected(tokenizer, rows):
    """rows: (key, text) in file order -> (key, start, n, crc)."""
    out, at = [], 0
    for k, t in rows:
        ids = np.array(whole(tokenizer, t), dtype="<u4")
        out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, tokenizer):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = expected(tokenizer, sorted((d["doc_id"], d["text"]) for d in docs))
    got = queries.op11_token_planes(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


ODD = ["", " ", "a", "Don't. STOP, it's we'll", "<|endoftext|> <|ENDOFTEXT|>a", "x.y,z... \"Q.\" (A), b!.", "é é ́x.   ſ",
       "İstanbul ΣΑΣ. ﬁ", "a\x1cb\x1d c\x85d\x0b\x0ce\x00f", "日本語。です, 12,345.67 ½", "z." * 50, "🙂🙂. a​b", "Å. K ㎏,", "﻿a b c"]


def test_chunks_have_the_ids_of_whole_texts(tokenizer, vocabulary):
    rng = random.Random(5)
    signs = [*"aAbZz09.,'\"<|>- \n\t \x1c\x85é́Σς日😀ǅß", "'s", "'LL", "<|endoftext|>", "the", "The,"]
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(4000)]
    found = idfiles.ChunkIds(vocabulary).texts(texts)
    for t, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == whole(tokenizer, t)[:-1], repr(t)


def test_forgetting_changes_nothing(tokenizer, vocabulary, monkeypatch):
    monkeypatch.setattr(idfiles, "MEMO", 5)
    chunks = idfiles.ChunkIds(vocabulary)
    for t in ODD * 2:
        assert np.frombuffer(chunks.texts([t, "one two"])[0], "<u4").tolist() == whole(tokenizer, t)[:-1]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("sizes", [[], [0], [1], [64], [63, 1, 1], [200, 0, 5, 64, 130], [1000], [0, 0, 0]])
def test_any_range_is_read_back(tmp_path, bits, sizes):
    rng = np.random.default_rng(1)
    ids = [rng.choice([rng.integers(0, 49408, n), rng.integers(0, 1 << 32, n)]).astype("<u4") for n in sizes]
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "x.ids")
    w = idfiles.IdWriter(fs, path, block=64, bits=bits)
    for k, x in enumerate(ids):
        w.add(None if k == 1 else k - 5, x.tobytes())
    w.close()
    f = idfiles.IdFile(fs, path)
    flat = np.concatenate([np.zeros(0, "<u4"), *ids])
    assert f.keys == [None if k == 1 else k - 5 for k in range(len(ids))] and f.n == len(flat)
    for a in range(0, len(flat) + 1, 7):
        for z in {a, a + 1, a + 63, a + 64, a + 200, len(flat)}:
            if a <= z <= len(flat):
                assert np.array_equal(f.ids(a, z), flat[a:z])
    got = [d for part in f.documents() for d in part]
    assert [d[2] for d in got] == [x.tobytes() for x in ids]
    assert [d[1] for d in got] == np.cumsum([0, *sizes])[:len(sizes)].tolist()


def test_damaged_planes_are_noticed(tmp_path):
    path = tmp_path / "x.ids"
    w = idfiles.IdWriter(pafs.LocalFileSystem(), str(path))
    w.add(1, np.arange(5000, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(path.read_bytes())
    raw[40] ^= 255
    path.write_bytes(raw)
    with pytest.raises(Exception):
        idfiles.IdFile(pafs.LocalFileSystem(), str(path)).ids(0, 5000)
    path.write_bytes(raw[:-9])
    with pytest.raises(ValueError):
        idfiles.IdFile(pafs.LocalFileSystem(), str(path))


def test_odd_rows(spark, tokenizer, vocabulary):
    rows = [(3, "b", 1), (None, "null key", 2), (3, "a", 3), (1, None, 4), (2, "", 5), (-4, "x " * 30000, 6), (3, "a", 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").withColumnRenamed("start", "ids")
    path = fresh_path(spark, "ids")
    idfiles.write_ids(df, path, vocabulary, 2, block=1000, file_ids=4000, bits=True)
    got = [tuple(r) for r in idfiles.read_ids(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -4, 1, 2, 3, 3, 3]
    assert [r[1] for r in got] == np.cumsum([0, *(len(r[2]) // 4 for r in got)])[:-1].tolist()
    want = sorted((k is not None, k or 0, whole(tokenizer, t)) for k, t, _ in rows)
    assert sorted((k is not None, k or 0, np.frombuffer(i, "<u4").tolist()) for k, _, i in got) == want


def test_other_tokenizer_by_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    folder = fresh_path(spark, "ids")
    idfiles.write_ids(spark.createDataFrame([(1, "Two  spaces\n"), (0, "é")], "k bigint, body string"), folder, path, 50256, "k", "body", chunked=False)
    got = {r["k"]: np.frombuffer(r["ids"], "<u4").tolist() for r in idfiles.read_ids(spark, folder, "k").collect()}
    assert got == {1: [*t.encode("Two  spaces\n").ids, 50256], 0: [*t.encode("é").ids, 50256]}


def test_empty_table(spark, vocabulary):
    folder = fresh_path(spark, "ids")
    idfiles.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), folder, vocabulary, 2)
    assert idfiles.read_ids(spark, folder).collect() == []
