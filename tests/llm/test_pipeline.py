"""The pipeline against a brute-force version of its own, on planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from tempograph.llm import simhash, toxicity
from tempograph.llm.common import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BAD = ["blorgface", "zwinkhead", "drabblepate", "schnuffnose"]


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "re", "sun", "ka", "vo", "pel"]) for _ in range(rng.randint(2, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(1, " ".join(prose(30))), (2, " ".join(prose(8))), (3, None)]
    docs, labels = [], []
    for i in range(240):
        w, bad = prose(rng.randint(40, 160)), i % 4 == 0
        for _ in range(8 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    base, passage = prose(300), " ".join(prose(70))
    for k in range(12):  # near copies: two words of 300 differ
        docs.append((300 + k, " ".join([*base[: 20 * k], "edit", f"e{k}", *base[20 * k + 2 :]])))
    docs += [(320, docs[1][1]), (321, docs[1][1].upper())]
    docs += [(330 + k, " ".join([*prose(20), passage, *prose(20)])) for k in range(3)]
    docs += [(340, " ".join([*prose(20), items[0][1], *prose(20)])), (341, f"{items[1][1]} x"), (342, " ".join(prose(400) + items[0][1].split()[:12]))]
    docs += [(350, None), (351, ""), (352, " \n"), (353, "one two"), (None, " ".join(prose(60))), (354, "z" * 30_000), (355, " ".join(prose(30_000)))]
    docs += [docs[5], docs[5]]
    return docs, labels, items


def score(model, text):
    """The score by hand: windows of eight words, compressed under either dictionary."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().translate(low))
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        size.append([len(c.compress(part[at : at + 1024])) for k in range(0, len(w), 8) for part in [b" ".join(w[k : k + 8])] for at in range(0, len(part), 1024)])
    gains = [a - b for a, b in zip(*size)]
    enough = [g for g in gains if g >= model.least]
    a, b, c = model.curve
    x = a + b * np.log(1 + 100 * len(enough) / max(1, len(gains))) + c * (min(12, max(enough)) / 12 if enough else 0)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs, labels, items = planted()
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int" if len(labels[0]) == 3 else "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, labels, items


def test_scores_by_hand(spark, world):
    sf, docs, labels, _ = world
    frames = [spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")]
    model = toxicity.train(*frames)
    got = {r.doc_id: r for r in toxicity.op5(*frames).collect()}
    for i, t in docs:
        assert got[i].score == pytest.approx(score(model, t or "")) and got[i].predicted == int(score(model, t or "") >= 0.5)
        assert got[i].held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([got[i].predicted == y for i, y in labels if got[i].held_out]) > 0.9


def brute(docs, model, items):
    library = __import__("tokenizers").Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    left = [(i, t) for i, t in docs if score(model, t or "") < 0.5]
    # near-duplicates: half of all shingles of two texts and more, by pairs
    low = lambda t: WORD.findall((t or "").encode().lower())
    grams = [set(zip(*[w[k:] for k in range(5)])) or {tuple(w)} for w in (low(t) for _, t in left)]
    root = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            share = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            assert share < 0.6 or share > 0.88  # nothing near the limit is planted
            if share > 0.8:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    first = {}
    for k, (i, _) in enumerate(left):
        if i is not None:
            first[root[k]] = min(first.get(root[k], i), i)
    left = [(i, t) for k, (i, t) in enumerate(left) if i == first.get(root[k])]
    # repeated spans of 50 words
    start = {}
    for i, t in left:
        w = WORD.findall((t or "").encode())
        for k in range(len(w) - 49 if i is not None else 0):
            g = tuple(w[k : k + 50])
            start[g] = min(start.get(g, i), i)
    cut = []
    for i, t in left:
        w, gone = WORD.findall((t or "").encode()), set()
        for k in range(len(w) - 49 if i is not None else 0):
            if start[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        cut.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t))
    # benchmark windows of 13 words
    plain = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = set()
    for _, t in items:
        w = plain(t)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    out = []
    for i, t in cut:
        w, hit = plain(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            ids = library.encode(t or "", add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_against_brute_force(spark, world):
    import corpus_pipeline as p

    sf, docs, _, items = world
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = brute(docs, model, items)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, sf).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = {r[0] for r in want}
    assert 300 in kept and not kept & set(range(301, 312)) and not kept & {320, 321, 340, 341} and {350, 353, 342, 355} <= kept


@pytest.mark.parametrize("bucket", [16, 1])
def test_similar(spark, bucket):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    rows = [(k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(0, 400, 10)] + [(1000 + k, " ".join(f"x{rng.randrange(10**6)}" for _ in range(200))) for k in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A B"), (None, "a b"), (2004, "a b c d e")]
    got = {(r.doc_id, r.component_id) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, bucket=bucket).collect()}
    want = {(i, 0) for i, _ in rows[:40]} | {(i, i) for i, _ in rows[40:100]} | {(2000, 2000), (2001, 2000), (2002, 2002), (2003, 2002), (None, 2002), (2004, 2004)}
    assert got == want
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string"), 0.8).count() == 0


def test_links_of_a_crowd_are_few(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(500):  # copies of one text, near it and often not near each other
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 3)):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, kept = [], simhash.stored

    def counted(df, name):
        out = kept(df, name)
        rows.append(out.count() if name != "fingerprints" else 0)
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, 0.8).collect()}
    bits = np.array([simhash.wide_fingerprint(t.encode()) for t in texts])
    near = np.bitwise_count(bits ^ bits[0]).sum(1, dtype=np.int64) <= simhash.wide_distance(0.8)
    assert near.sum() > 400 and {got[k] for k in np.flatnonzero(near).tolist()} == {0}
    # No block makes as many links as it has rows.
    assert sum(rows) < len(texts) * simhash.shape(len(texts), 0.8)[1]


def test_connecting_links():
    rng = np.random.default_rng(6)
    for n, copies in [(1, 1), (40, 40), (700, 300)]:
        base = rng.integers(0, 2**64, (n, simhash.WIDE // 64), np.uint64)
        for k in range(copies):  # near the first one
            base[k] = base[0] ^ np.packbits(rng.random(simhash.WIDE) < 0.09).view(np.uint64)
        part = rng.integers(0, max(1, 3 * n // 4), n)
        i, j = simhash.connecting(part, base, 90, 18)
        d = np.bitwise_count(base[:, None] ^ base[None]).sum(2, dtype=np.int64)
        rough = np.bitwise_count(base[:, None, 0] ^ base[None, :, 0]) <= 18
        assert (d[i, j] <= 90).all() and len(i) < n

        def classes(x, y):
            root = list(range(part.max() + 1))
            for p, q in zip(part[x].tolist(), part[y].tolist()):
                p, q = root[p], root[q]
                root = [q if r == p else r for r in root] if p != q else root
            return [[root[p] == root[q] for q in range(len(root))] for p in range(len(root))]

        assert classes(i, j) == classes(*np.nonzero((d <= 90) & rough))
