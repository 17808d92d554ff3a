"""Whole outputs of operators (texts, spans, ids, payloads, shards), and null, equal and repeated ids."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tempograph.llm import bpe, decontam, idfile, shards, simhash, tokcount, tsmedia, warc
from tempograph.llm.common import join_classes, tokenizer_path

ODD = [(3, "one two three"), (3, "one two three"), (3, "other words"), (None, "nobody's é"), (None, None), (1, ""), (2, "x " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "s") for i, t in ODD], "doc_id long, text string, n_tokens int, source string").repartition(3).cache()


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "A, b! c d e f"), (2, None), (3, "c d"), (None, "x c d y c d"), (1, "A, b! c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "C D")], "item_id long, text string")
    got = Counter((r.doc_id, r.text) for r in decontam.remove_spans(docs, bench).collect())
    assert got == Counter({(1, "a b e f"): 2, (2, ""): 1, (3, ""): 1, (None, "x y"): 1})


def test_ids_come_back(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    path = f"file://{tmp_path}/ids"
    idfile.write_ids(odd, path, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(idfile.read_ids(spark, path).collect(), key=lambda r: r.start)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, ids(t)) for i, t in ODD)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", 1), (2, None, "<p>é</p>", 2), (3, "http://c", None, 3)], "page_id long, url string, html string, payload int")
    source, target = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    warc.write_monolithic(pages, source)
    got = {r.page_id: (r.record_type, r.refers_to, r.url, r.payload) for r in warc.read_records(warc.normalise(spark, source, target)).collect()}
    assert got[2][0] == "response" and got[2][3] == "<p>é</p>" and got[1][:2] == ("revisit", 2) and got[1][3] is None and got[3] == ("response", None, "http://c", "")


def test_shards_are_written(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k % 90 if k % 11 else None, "w" * rng.randint(0, 400), k) for k in range(300)] + [(7, "same", 1), (7, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shards.shard(docs.withColumnRenamed("shard", "mine"), 5, 20, keep=["mine", "text"]).collect()
    assert Counter((r.doc_id, r.text, r.mine) for r in out) == Counter(rows)
    size, total = Counter(), sum(len(t) + 16 for _, t, _ in rows)
    for r in out:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(r.text) + 16, zlib.crc32(r.text.encode()), "bytes", None)
        size[r.shard] += r.size
    assert set(size) == set(range(5)) and all(abs(n - total / 5) <= 2 * 416 for n in size.values())
    for k in range(5):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    shards.write_shards(docs, f"file://{tmp_path}/shards", 5, ranges=20)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(tuple(r.record) for r in back.collect()) == Counter(rows)
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in out} or back.count() == len(rows)


def test_odd_ids(odd):
    def rows(df, *columns):
        return Counter(tuple(r[c] for c in columns) for r in df.collect())

    assert rows(bpe.op2(odd), "doc_id")[(3,)] == 3 and rows(bpe.op2(odd), "doc_id")[(None,)] == 2
    counts = rows(tokcount.op7(odd), "doc_id", "n_bytes")
    assert counts == Counter((i, len((t or "").encode())) for i, t in ODD)
    media = rows(tsmedia.op10(odd), "doc_id", "n_bytes", "whole")
    assert media == Counter((i, len((t or "").encode()), True) for i, t in ODD)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.op3(odd).collect()}
    assert simhash.op3(odd).count() == len(ODD) and found[1, "0" * 16] == 1 and found[None, "0" * 16] == 1
    assert rows(shards.op8(odd), "doc_id", "size") == Counter((i, len((t or "").encode()) + 16) for i, t in ODD)


@pytest.mark.parametrize("heavy", [1000, 4])
def test_classes_join_by_either_way(spark, monkeypatch, heavy):
    from tempograph.llm import common

    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = ["hot"] * 60 + ["warm"] * 9 + ["cold", "alone", "gone"]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k string, at long")
    classes = spark.createDataFrame([(k, n, k.upper(), k != "alone") for k, n in Counter(keys).items() if k != "gone"], "k string, n long, name string, good boolean")
    want = [(k, n, k.upper()) for n, k in enumerate(keys) if k not in ("gone", "alone")]
    got = join_classes(rows, classes, "k", "at", len(keys), wanted="good")
    assert got.columns == ["k", "at", "name", "good"] and sorted((r.k, r.at, r.name) for r in got.collect()) == sorted(want)
    left = join_classes(rows, classes, "k", "at", len(keys), how="left")
    assert sorted((r.k, r.at, r.name) for r in left.collect()) == sorted((k, n, None if k == "gone" else k.upper()) for n, k in enumerate(keys)) if heavy else True


def test_coder_works_on_32_bits():
    model = idfile.Model()
    ids = np.array([0, 7, 65535, 7], np.int32)
    guessed = model.guesses(ids, ids[::-1].copy())
    start, width = model.intervals(*guessed, ids)
    found = model.find(*guessed, start + width - 1)
    assert {x.dtype for x in (start, width, *found)} == {np.dtype(np.int32)}
    assert all((x == y).all() for x, y in zip(found, (ids, start, width)))
    rng = np.random.default_rng(3)
    for block in (rng.integers(0, 65536, 70_001), np.full(40_000, 65535), np.minimum(rng.zipf(1.3, 300_000), 65535), np.array([5])):
        assert (idfile.unpack_ids(idfile.pack_ids(block), len(block)) == block).all()
