"""Operators 11 to 13 against brute force, and near-duplicates near their limit."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest

from tempograph.llm import phrases, prefixtrie, quality, queries, simhash, tokcount, tsmedia
from tempograph.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string, ids long, label string, rank int"


def conversations():
    rng = random.Random(3)
    rows = []
    shared = [("system", "be kind"), ("user", "hello"), ("assistant", "é" * 40)]
    for c in range(60):
        own = shared[: rng.randint(0, 3)] + [(rng.choice(["user", None]), rng.choice(["a", "b", None, "x y"])) for _ in range(rng.randint(0, 5))]
        rows += [(c, t, *x) for t, x in enumerate(own)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(9)]  # copies
    rows += [(141, t, "user", f"turn {t}") for t in range(40)] + [(142, t, "user", f"turn {t}" if t < 39 else "other") for t in range(40)]
    rows += [(200, None, "user", "first"), (200, None, "system", "first"), (200, 0, "user", "then"), (200, 0, "user", "then"), (None, 0, "user", "nobody's"), (10**12, 5, "user", "z" * 200_000)]
    rng.shuffle(rows)
    return rows


def nodes_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest(), t))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}

    def walk(p):
        cost = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [walk(q) for q in children[p]]
        leaves, saved = sum(b[0] for b in below) or 1, cost + sum(b[1] for b in below)
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        return leaves, saved

    walk(())
    return out


@pytest.mark.parametrize("limit", [None, 1, 30])
def test_prefix_trie(spark, limit):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS).repartition(3)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in prefixtrie.op11(df, limit).collect()}
    assert got == nodes_by_hand(rows)
    if limit is None:
        assert prefixtrie.op11(df.limit(0)).count() == 0
        only = prefixtrie.op11(spark.createDataFrame([(7, None, None, None)], "conv_id long, turn long, role string, text string")).collect()
        assert sorted((r.conv_id, r.depth, r.n_convs) for r in only) in ([(7, 0, 1)], [(7, 0, 1), (7, 1, 1)])


def test_pieces_of_ends(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefixtrie, "PIECE", 5)
    ids = [1, 2, 30, 400, 5000, 60000]
    batches = [pa.RecordBatch.from_pydict({"key": ["a"] * 4, "conv_id": ids[:4]}), pa.RecordBatch.from_pydict({"key": ["a", "a", "b"], "conv_id": [*ids[4:], 7]})]
    made = list(prefixtrie._pieces(iter(batches)))
    assert sum(b.num_rows for b in made) > 3
    found = {k: e for b in prefixtrie._digests(iter(made)) for k, e in zip(b["key"].to_pylist(), b["ends"].to_pylist())}
    assert found == {"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "b": hashlib.sha256(b"7").hexdigest()}


def texts():
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "delta", "été", "x-1", "\x00", "ß"])
    out = [("en", None), (None, "alpha beta. alpha beta\talpha  beta"), ("en", ""), ("de", " \x0b;,! "), ("en", "zeta " * 300), ("fr", "a b" * 50)]
    for k in range(120):
        body = "".join(word() + rng.choice([" ", " ", " ", "\t", ", ", ".\n", " new york city hall "]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None]), body))
    return out + out[10:14]


def collocations_by_hand(rows, top, least, longest=5, percent=100):
    f, n, low = Counter(), Counter(), {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for k in range(len(w) - m + 1):
                    f[lang, tuple(w[k : k + m])] += 1
    some = {p: a for p, a in f.items() if a >= least}
    found = []
    for (lang, p), a in some.items():
        inside = lambda q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        if len(p) < 2 or any(x == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (x, q), b in some.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out = set()
    for lang in n:
        best = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out |= {(lang, r, p, a, l, rr, m, s) for r, (_, s, a, p, l, rr, m) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block, least, top, percent", [(phrases.BLOCK, 8, 2000, 100), (7, 8, 9, 100), (40, 20, 2000, 60), (1, 30, 2000, 100)])
def test_phrases(spark, block, least, top, percent):
    rows = texts()
    docs = spark.createDataFrame([(k, t, lang, "w", 3) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n long").repartition(3)
    got = phrases.collocations(docs, top, least, percent=percent, block=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == collocations_by_hand(rows, top, least, percent=percent)
    if block == 7:
        assert phrases.op12(docs.limit(0)).count() == 0


def test_phrases_across_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 10)
    assert [w for p in phrases.pieces(b"One two,THREE  four five six seven") for w in p] == [b"one", b"two", b"\xff", b"three", b"four", b"five", b"six", b"seven"]
    import numpy as np

    for kind in (np.int32, np.int64, np.uint32):
        for n in (0, 1, 1000):
            a = (np.arange(n) * 977 % 4099).astype(kind)
            assert (phrases.unpacked(phrases.packed(a), kind) == a).all()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_phrases"])
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall()))


def counts_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(spark):
    rng = random.Random(6)
    some = [None, "", " \n\t", "a b c a b c", "x " * 70, "é漢 😀\x1c\x85　y\n\né漢 😀\x1c\x85　y\n", "#$%&*|<> ##", "one two", "z" * 100_000, "a b c d a b c\r\na b"]
    some += ["".join(rng.choice(["sun ", "moon ", "sun\n", "# ", "été, "]) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    docs = spark.createDataFrame([(k if k else None, t, "s", 1) for k, t in enumerate(some)] + [(5, some[5], "s", 1)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.op13(docs, labels)
    rows = got.collect()
    want = [(k if k else None, *counts_by_hand(t)) for k, t in enumerate(some)] + [(5, *counts_by_hand(some[5]))]
    assert Counter(tuple(r)[:6] for r in rows) == Counter(want)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.op13(docs.limit(0), labels).count() == 0


def test_exact_bound():
    for n, p, chance in ((10, 0.3, 0.05), (300, 0.02, 0.05), (300, 0.02, 0.001), (1000, 0.1, 0.01), (40, 0.02, 0.05)):
        total, k = 0.0, -1
        while (total := total + comb(n, k + 1) * p ** (k + 1) * (1 - p) ** (n - k - 1)) <= chance:
            k += 1
        assert quality.most_allowed(n, p, chance) == k
    assert 1_940_000 < quality.most_allowed(10**8, 0.02, 0.05) < 2_000_000


def judged_by_hand(rows, labels, risk, error, worth):
    """The whole method again, on lists: rows are (doc_id, stratum, values, base_failed)."""
    label = {}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = min(q, label.get(i, q))
    own = {}
    for i, s, v, failed in rows:
        if not failed and i in label:
            own[i] = min(own.get(i, (s, v)), (s, v))
    fit, held = defaultdict(list), defaultdict(list)
    for i, (s, v) in own.items():
        (fit if zlib.crc32(str(i).encode()) % 4 == 0 else held)[s].append((v, label[i]))
    wished = {}
    for s, left in fit.items():
        for _ in range(len(quality.rules())):
            best = None
            for r in range(len(quality.rules())):
                for c in {v[r] for v, _ in left if v[r] > 0}:
                    gain = sum((1 if q == 0 else -worth) for v, q in left if v[r] >= c)
                    best = max(x for x in (best, (gain, c, -r)) if x is not None)
            if best is None or best[0] <= 0:
                break
            wished[s, -best[2]] = best[1]
            left = [x for x in left if x[0][-best[2]] < best[1]]
    limits = {}
    for (s, r), c in wished.items():
        good = [v[r] for v, q in held[s] if q == 1]
        n_rules = sum(x == s for x, _ in wished)
        k = quality.most_allowed(len(good), risk / n_rules, error / len(wished)) if good else -1
        if k >= 0:
            limits[s, r] = next(x for x in range(c, quality.TOP + 2) if sum(g >= x for g in good) <= k)
    return [(i, not failed and not any(v[r] >= limits.get((s, r), quality.TOP + 1) for r in range(len(v)))) for i, s, v, failed in rows], limits


def test_quality_cutoffs(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(2400):
        bad = i % 6 == 0
        kind = rng.randrange(3)
        word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
        words = [word(rng.randint(9, 12) if bad and kind == 0 else rng.randint(2, 8)) for _ in range(rng.randint(55, 90))]
        words = [w + ("#" if (bad and kind == 1 and rng.random() < 0.4) or rng.random() < 0.004 else "") for w in words]
        text = "\n".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6))
        text += ("\n" + " ".join(words[:6])) * (4 if bad and kind == 2 else 0)
        docs.append((i if i % 97 else None, text, ["en", "de", None, "fr"][min(3, i % 7 // 2)]))
        if i % 5:
            labels.append((i, int(not bad)))
    labels += [(1, 0), (None, 1), (4, None)]
    docs += docs[10:20]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    for risk in (0.05, 0.3):
        rows = [(r.doc_id, r.stratum, tuple(r.v), r.base_failed) for r in quality.described(frame).select("doc_id", "stratum", quality.F.array(*quality.rules().values()).alias("v"), "base_failed").collect()]
        want, limits = judged_by_hand(rows, labels, risk, 0.05, 10)
        got = quality.judged(frame, marks, risk=risk).select("doc_id", "kept").collect()
        assert Counter(map(tuple, got)) == Counter(want)
    assert limits and not all(k for _, k in want)  # with the wider risk there are certificates


def test_similar_near_the_limit(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    grams = lambda t: set(zip(*[t[k:] for k in range(5)]))
    docs, pairs = [], []
    for i in range(0, 500, 2):
        base = [word() for _ in range(rng.randint(200, 500))]
        other = list(base)
        for k in rng.sample(range(len(base)), round(len(base) * rng.uniform(0.017, 0.024))):
            other[k] = word()
        share = len(grams(base) & grams(other)) / len(grams(base) | grams(other))
        docs += [(i, " ".join(base)), (i + 1, " ".join(other))]
        pairs.append((i, share))
    shared = [word() for _ in range(120)]  # a third of each of these texts: one crowd, no near-duplicates
    docs += [(1000 + k, " ".join(shared + [word() for _ in range(240)])) for k in range(1000)]
    near = [word() for _ in range(300)]
    docs += [(3000 + k, " ".join([*near[: k % 290], f"e{k}", *near[k % 290 + 1 :]])) for k in range(400)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 0.8).collect()}
    limit = [got[i + 1] == i for i, s in pairs if 0.8 <= s < 0.85]
    assert len(limit) > 100 and sum(limit) / len(limit) >= 0.9
    assert len({got[1000 + k] for k in range(1000)}) == 1000
    assert {got[3000 + k] for k in range(400)} == {3000}


def test_every_letter_counts_as_in_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), tokcount.Counter(path)
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{x} {x}B {x}" for x in letters]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [hex(ord(x)) for x, t, n in zip(letters, texts, want) if counter.total(tokcount.split_blanks(t)) != n]
    assert wrong == []


def test_damaged_streams_are_marked(spark):
    rng = random.Random(1)
    payload = rng.randbytes(tsmedia.UNIT * 2 + 640)
    stream = tsmedia.mux_bytes(payload)
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    tables = len(tsmedia.TABLES) // 188
    whole = tsmedia.demux_bytes(stream)
    assert whole.whole and whole.payload == payload and whole.gaps == 0
    for k in range(tables, len(packets)):
        again = tsmedia.demux_bytes(b"".join([*packets[: k + 1], *packets[k:]]))
        assert again.whole and again.payload == payload and again.gaps == 0
        lost = tsmedia.demux_bytes(b"".join(packets[:k] + packets[k + 1 :]))
        assert not lost.whole or len(lost.payload) < len(payload)
    with pytest.raises(ValueError):
        tsmedia.demux_bytes(b"".join(packets[:tables] + packets[tables + 1 : tables + 3]))
    media = [(1, len(payload), stream), (2, len(payload), b"".join(packets[:8] + packets[9:])), (3, len(payload) + 64, stream), (None, None, stream)]
    got = {r.doc_id: r for r in tsmedia.demux(spark.createDataFrame(media, "doc_id long, n_bytes long, media binary")).collect()}
    assert {k: r.whole for k, r in got.items()} == {1: True, 2: False, 3: False, None: True}
    assert got[2].payload is None and got[2].payload_sha256 is None and got[2].payload_bytes is None and bytes(got[1].payload) == payload
