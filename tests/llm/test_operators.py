"""The operators against brute force, on a fixture with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograph.llm import bpe, decontam, idfile, shards, simhash, substr, tokcount, toxicity, tsmedia, warc
from tempograph.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, kept string, spans string, key long, row long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "sun", "moon", "river", "Stone", "été", "naïve", "x1", "long-winded", "don't"]) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def texts():
    rng = random.Random(7)
    shared = " ".join(f"p{k}" for k in range(70))
    base = [prose(rng, n) for n in (0, 1, 2, 3, 12, 13, 40, 49, 50, 51, 120, 3000)]
    out = [None, "", " \n\t", "a" * 5000, "<|endoftext|> x<|endoftext|>", "漢字 かな 😀", *base, base[-2], base[-2], f"{prose(rng, 30)} {shared} {prose(rng, 30)}", f"{prose(rng, 9)} {shared} end", shared]
    near = prose(rng, 400).split(" ")
    for k in range(30):
        out.append(" ".join([*near[:k], "edit", *near[k + 1 :]]))
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "s", 5, 9) for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def utf8(t):
    return (t or "").encode()


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    long = " ".join(f"P{k}!" for k in range(10, 40))
    items = [(1, long), (2, "moon RIVER"), (3, ""), (4, None), (None, "the"), (10, "moon river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    split = lambda t: word.findall(utf8(t).translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    want = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    found |= owners
                    hit |= set(range(k, k + n))
        want[i] = (len(w), len(hit), len(found), decontam.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w))
    for words in (decontam.SLICE_WORDS, 3):  # in one broadcast, and in several
        monkeypatch.setattr(decontam, "SLICE_WORDS", words)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op1(docs, bench).collect()}
        assert got == want
    kept = decontam.remove_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert decontam.op1(empty, bench).count() == 0
    assert decontam.op1(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op2(docs).collect()} == want
    assert bpe.op2(empty).count() == 0


def test_bpe_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(3)
    alphabet = "ab  \n\t'st.,!1é漢\x1c\x85\xa0　İΣ😀"
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(800)]
    monkeypatch.setattr(bpe, "LONG", 20)
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "PARTS", 50)
    monkeypatch.setattr(idfile, "LONG", 20)
    some += ["<|endoftext|>".join(some[k : k + 3]) for k in range(100)]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [list(bpe.unpacked(x)) for x in bpe.Encoder(path).encode(some)] == want
    assert [x.tolist() for x in map(idfile.TextEncoder(path).encode, some)] == want


@pytest.mark.parametrize("bucket", [16, 2])
def test_simhash(docs, rows, empty, bucket):
    fp = {i: simhash.fingerprint(utf8(t)) for i, t in rows}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {i for i in fp if find(i) == i}
    assert simhash.op3(empty).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    text = "One two THREE four five"
    h = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in (["one", "two", "three"], ["two", "three", "four"], ["three", "four", "five"])]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) >= 2)
    assert simhash.fingerprint(b"") == 0


def test_token_file(docs, rows, empty):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in idfile.op4(docs).collect()} == want
    assert idfile.op4(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 300, 5000, 70000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.7, rng.integers(0, 30, n), rng.integers(0, 65536, n))
    block = idfile.pack_block([(5, ids[: n // 2]), (None, ids[n // 2 :])])
    back = idfile.unpack_block(block)
    assert [d for d, _ in back] == [5, None] and (np.concatenate([x for _, x in back]) == ids).all()
    with pytest.raises(ValueError):
        idfile.unpack_block(block[:-1] + bytes([block[-1] ^ 1]))


def test_toxicity(spark, empty):
    rng = random.Random(1)
    vowel = lambda: "".join(rng.choice(["ta", "lo", "mi", "re", "sun", "ka"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(700):
        w, bad = [vowel() for _ in range(rng.randint(30, 200))], i % 6 == 0
        for _ in range(rng.randint(3, 8) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["blorgface", "zwinkhead", "drabble", "schnuff"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows + [(9001, None), (9002, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op5(docs, marks).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out and i < 9000} == set(held)
    assert np.mean([got[i].predicted == int(i % 6 == 0) for i in held]) > 0.95
    assert got[9001].predicted == got[9002].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.op5(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.op5(empty, marks).count() == 0


def test_toxicity_of_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    plain = lambda n: " ".join("".join(rng.choice(["ta", "lo", "mi", "re", "sun", "ka"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    bad = lambda: " ".join(f"{plain(9)} {w}" for w in ("blorgface", "zwinkhead", "drabble", "schnuff"))
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"{plain(4600)} {bad()}" if i % 3 == 0 else plain(60)) for i in learnt]  # toxic behind character 20,000
    assert all(len(t) < 20_000 or t.index("blorgface") > 20_000 for _, t in rows)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in learnt], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert all(w in model.toxic for w in (b"blorgface", b"zwinkhead", b"drabble", b"schnuff"))
    scorer = toxicity.Scorer(model)
    assert scorer.score(f"{plain(20)} {bad()}".encode()) > scorer.score(plain(60).encode())
    gains = np.array([0, 3, 0, 0, 5, 0, 1, 0])
    assert (toxicity.features(np.tile(gains, 40), 2) == toxicity.features(gains, 2)).all()
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary, _: seen.append((toxic, ordinary)))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 100_000)
    toxicity.train(docs, labels)
    whole = {t.encode() for _, t in rows}
    assert all(set(x) <= whole and 0 < sum(map(len, x)) <= 100_000 for x in seen[0])


def test_substrings(docs, rows, empty):
    word, first = re.compile(rb"[^\x20\x09-\x0D]+"), {}
    for i, t in rows:
        w = word.findall(utf8(t))
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t in rows:
        w, gone = word.findall(utf8(t)), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    assert any(w[1] for w in want.values())
    assert {r.doc_id: tuple(r)[1:] for r in substr.op6(docs).collect()} == want
    assert substr.op6(empty).count() == 0


def test_substrings_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 300), (2, "a " * 120 + "b"), (2, "a " * 120 + "b"), (None, "a " * 300)], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substr.op6(docs).collect()]
    assert Counter(got) == Counter([(1, 300, 0), (2, 121, 120), (2, 121, 120), (None, 300, 0)])


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: (len(utf8(t)), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows}
    path = tokenizer_path("word_bpe_49k.json")
    for chunk, fan in ((tokcount.CHUNK, tokcount.FAN), (7, 5), (7, 10_000)):
        got = tokcount.count_tokens(docs, path, chunk=chunk, fan=fan).collect()
        assert {r.doc_id: tuple(r)[1:4] for r in got} == want
        counter, text = tokcount.counter(path), dict(rows)
        for r in got:  # what ended before each chunk, by counting up to its last white space
            t = text[r.doc_id] or ""
            upto = [max((m.end() for m in tokcount.BLANK.finditer(t[:at])), default=0) for at in range(0, max(1, len(t)), chunk)]
            assert r.chunk_starts == [counter.total(tokcount.split_blanks(t[:at])) for at in upto]
    assert tokcount.op7(empty).count() == 0


def test_sharding(spark, docs, rows, empty):
    hot = docs.select("doc_id", "text").unionByName(spark.range(1000, 1400).selectExpr("id as doc_id", "repeat('hot ', 100) as text"))
    got = shards.op8(hot).collect()
    assert len(got) == hot.count()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    fair = sum(size.values()) / 40
    assert set(size) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) - fair <= 2 * max(r.size for r in got)
    text = dict(rows)
    assert all((r.size, r.text_crc32) == (len(utf8(text[r.doc_id])) + 16, zlib.crc32(utf8(text[r.doc_id]))) for r in got if r.doc_id < 1000)
    assert shards.op8(empty).count() == 0


def test_warc(spark):
    rows = [(k, f"http://x/{k}", h) for k, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é\r\n\r\nWARC/1.1", "y" * 3_000_000, "<p>a</p>"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {}
    for k, _, h in rows:
        last[h or ""] = k
    want = {k: (len(utf8(h)), base64.b32encode(hashlib.sha1(utf8(h)).digest()).decode(), *(("response", None) if last[h or ""] == k else ("revisit", last[h or ""]))) for k, _, h in rows}
    assert {r.page_id: tuple(r)[1:] for r in warc.op9(pages).collect()} == want
    assert warc.op9(pages.limit(0)).count() == 0


def test_media(docs, rows, empty):
    got = {r.doc_id: r for r in tsmedia.op10(docs).collect()}
    for i, t in rows:
        payload = tsmedia.padded(utf8(t))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(utf8(t)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes % 188 == 0 and r.feature.endswith("gaps=0")
    assert tsmedia.op10(empty).count() == 0
    stream = tsmedia.mux_bytes(bytes(1000))
    assert tsmedia.demux_bytes(stream[: 3 * 188] + stream[4 * 188 :]).gaps == 1
    with pytest.raises(ValueError):
        tsmedia.demux_bytes(b"\x00" + stream[1:])


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == p.COLUMNS and docs.count() <= before.count(), name
    want = {tuple(r) for r in p.STAGES[-1][1](spark, docs, sf).collect()}
    assert {tuple(r) for r in p.run(spark, sf).collect()} == want


def mapped(monkeypatch, frame):
    """The frames and functions that mapInArrow is given from now on."""
    calls, kept = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, *a, **b: calls.append((self, f)) or kept(self, f, *a, **b))
    return calls


def test_bpe_gives_its_memory_back(docs, monkeypatch):
    path, calls = tokenizer_path("byte_bpe_50k.json"), mapped(monkeypatch, docs)
    bpe.encode_documents(docs, path)
    some = [" ".join(f"word{k}x{j}." for j in range(300)) for k in range(40)]
    out = list(calls[0][1](iter([pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": some})])))
    assert [x for b in out for x in b["ids"].to_pylist()] == bpe.Encoder(path).encode(some)
    enc = bpe.encoder(path)  # stays in the worker, whose next task may be another operator's
    assert not any(x.young or x.old for x in (enc.spaced, enc.bare, enc.pieces)) and not enc.merges.memo


def test_bpe_remembers_few_words(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 100)
    monkeypatch.setattr(bpe, "PARTS", 100)
    enc = bpe.Encoder(tokenizer_path("byte_bpe_50k.json"))
    learnt = []
    monkeypatch.setattr(enc, "_encode_words", lambda words, f=enc._encode_words: learnt.append(words) or f(words))
    for k in range(60):  # one word comes again and again among words that come once
        enc.encode([" ".join(["x", "often", *(f"once{k}a{j}" for j in range(20))])])
        assert all(len(x.young) <= 100 and len(x.old) <= 100 for x in (enc.spaced, enc.bare, enc.pieces))
    assert sum(w.count(" often") for w in learnt) == 1


def test_toxicity_sends_a_kept_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, "de"), (None, "", None)], "doc_id long, text string, lang string")
    calls = mapped(monkeypatch, docs)
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Model(b"", b"", 2, (-3.0, 0.0, 0.0)))
    left = toxicity.reject(docs, docs)
    assert calls[0][0].schema.simpleString().count("string") == 2  # text and lang
    assert left.dtypes == docs.dtypes and sorted(left.collect(), key=str) == sorted(docs.collect(), key=str)
    only = docs.select(F.col("text").alias("words"), F.col("text").cast("binary").alias("_doc"), F.lit(5).alias("score"))
    assert sorted(toxicity.reject(only, docs, "score", "words").collect(), key=str) == sorted(only.collect(), key=str)
    assert sorted(toxicity.reject(only, docs, "score", "_doc").collect(), key=str) == sorted(only.collect(), key=str)
