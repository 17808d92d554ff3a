"""How many rows queries shuffle, and that what spares rows spares no results."""

import random

import pytest


def shuffled(df):
    """Rows that the shuffles of a collected DataFrame have written."""

    def of(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(k)) for k in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def shuffled_by_all(spark, run):
    """What run returns, and the rows that all shuffles of its jobs have written, those before checkpoints too."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))}

    before = rows()
    got = run()
    return got, sum(n for k, n in rows().items() if k not in before)


@pytest.fixture
def unhinted(spark):
    """Small tables are joined as large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sieve_leaves_what_matches(spark):
    from tempograph.plans.sieve import sieved

    rows = spark.range(20000).selectExpr("id", "if(id % 3 = 0, null, concat('k', id)) AS k")
    wanted = spark.range(0, 20000, 40).selectExpr("if(id % 3 = 0, null, concat('k', id)) AS w", "id AS i")
    got = {r.id for r in sieved(rows, ["k", "id"], wanted, ["w", "i"]).collect()}
    assert got >= set(range(0, 20000, 40)) and len(got) < 2500
    few = {r.id for r in sieved(rows, ["k", "id"], wanted, ["w", "i"], most=1 << 10).collect()}  # a table that is too small lets others pass, and keeps all
    assert few >= set(range(0, 20000, 40))
    assert sieved(rows, ["id"], wanted.where("false"), ["i"]).count() == 0


def test_names_within_shuffles_few_parts_and_deals_out_hot_names(spark, monkeypatch, unhinted):
    from tempograph.operators.joins import names_within
    from tempograph.plans import sieve

    monkeypatch.setattr(sieve, "CHUNK", 3)
    word = random.Random(3)
    names = ["".join(word.choice("abcd") for _ in range(n)) for n in range(20, 60)] + ["Hot"] * 10 + ["a hot one"] * 8 + ["ho", "", None, "hOT onE"]
    rows = [(k, k % 2, n) for k, n in enumerate(names)]
    df = names_within(spark.createDataFrame(rows, "id long, entity_type_id int, name string"))
    got = sorted((r.short, r.long) for r in df.collect())
    low = [(i, t, n.lower()) for i, t, n in rows if n and len(n) >= 3]
    assert got == sorted((i, j) for i, t, n in low for j, u, m in low if t == u and n in m and (i < j if n == m else i != j))
    assert shuffled(df) < 600  # over eight thousand parts are as long as another name


def test_reach_by_classes_is_the_same(spark, monkeypatch):
    from tempograph.operators import graph
    from tempograph.plans import sieve

    monkeypatch.setattr(sieve, "CHUNK", 2)
    dice = random.Random(5)
    edges = [(dice.randrange(30), dice.randrange(30), dice.randrange(12)) for _ in range(90)] + [(0, 0, 1), (1, 2, 1), (2, 1, 1), (1, 2, 1), (3, None, 1)]
    facts = spark.createDataFrame([(a, b, 5 if s == 0 else 1, s == 2) for a, b, s in edges], "subject_id long, object_id long, fact_status_id int, pending boolean")
    out = {}
    for a, b, s in edges:
        if b is not None and s not in (0, 2):
            out.setdefault(a, set()).add(b)
    roots = [*range(0, 20), 77]
    for depth in range(5):
        got = graph.reach(facts, spark.createDataFrame([(r,) for r in roots], "root long"), depth).collect()
        want = set()
        for r in roots:
            seen, front = {r: 0}, {r}
            for k in range(1, depth + 1):
                front = {b for a in front for b in out.get(a, ())} - seen.keys()
                seen |= {b: k for b in front}
            want |= {(r, n, d) for n, d in seen.items()}
        assert sorted((x.root, x.node, x.distance) for x in got) == sorted(want)


def test_reach_does_not_shuffle_its_last_level(spark, unhinted):
    from tempograph.operators import graph

    roots = spark.range(300).selectExpr("id AS root")
    edges = roots.selectExpr("root AS subject_id", "explode(array(1000, 1001, if(root = 7, 2005, 1000))) AS object_id").unionAll(spark.range(2000, 2200).selectExpr("explode(array(1000, 1001)) AS subject_id", "id AS object_id"))
    facts = edges.selectExpr("subject_id", "object_id", "1 AS fact_status_id", "false AS pending")
    got, n = shuffled_by_all(spark, lambda: graph.reach(facts, roots, 2).groupBy("distance").count().collect())
    assert {x["distance"]: x["count"] for x in got} == {0: 300, 1: 601, 2: 300 * 200 - 1}
    assert n < 12000  # the last level alone has sixty thousand rows


def test_insert_batch_shuffles_what_the_batch_can_reach(spark, unhinted):
    from tempograph.operators.writes import insert_batch

    facts = spark.range(20000).selectExpr("concat('f', id) AS id", "id % 10 AS subject_id", "'supplies' AS predicate", "id AS object_id", "cast(null AS string) AS object_literal", "timestamp'2020-01-01' AS valid_from", "cast(null AS timestamp) AS valid_until", "0.5D AS confidence", "1 AS fact_status_id", "false AS pending", "false AS inferred")
    sources = facts.selectExpr("id AS fact_id", "2 AS source_type_id", "id AS raw_reference")
    batch = facts.where("object_id % 1000 = 3").selectExpr("concat('n', object_id) AS id", "* except (id)", "object_id AS arrival", "2 AS source_type_id", "if(object_id > 10000, concat('f', object_id), 'new') AS raw_reference")
    got, n = shuffled_by_all(spark, lambda: insert_batch(facts, sources, batch, ("supplies",)).collect())
    assert sorted((r.id, r.is_new, r.fact_status_id, round(r.confidence, 6), r.added_sources) for r in got) == sorted((f"f{k}", False, 1, 0.5 if k > 10000 else 0.55, int(k < 10000)) for k in range(3, 20000, 1000))
    assert n < 5000  # each of the twenty thousand facts and sources was shuffled


def test_messages_match_by_blocks(spark, unhinted, monkeypatch):
    import math

    from tempograph.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 600)
    dice = random.Random(7)
    texts = [" ".join(dice.choices("tea Tea milk sugar cup pot jam oat rye fig".split(), k=dice.randrange(1, 9))) for _ in range(400)]
    rows = [(k // 4, f"m{k % 4}", t) for k, t in enumerate(texts)] + [(0, "m0", "tea tea"), (0, "m0", texts[0]), (None, None, "jam JAM"), (None, "a", "jam jam"), (5, "z", None), (5, "y", "")]
    messages = spark.createDataFrame(rows, "session long, name string, said string")
    plans = [(k, dice.sample("tea milk sugar cup pot jam oat rye fig none".split(), 3)) for k in range(60)] + [(97, ["none"]), (98, []), (99, ["jam", "jam", "tea"])]
    df = retrieval.matching_messages(spark.createDataFrame(plans, "task_id long, terms array<string>"), messages, ["session", "name"], "said", 7)
    got, n = shuffled_by_all(spark, df.collect)
    index = {}
    for s, m, t in rows:
        words = (t or "").lower().split()
        for w in set(words):
            index[(s, m, w, len(words))] = index.get((s, m, w, len(words)), 0) + words.count(w)
    mean = sum(len((t or "").split()) for _, _, t in rows) / len(rows)
    idf = {}
    for w in {k[2] for k in index}:
        d = sum(k[2] == w for k in index)
        x = math.log((len(rows) - d + 0.5) / (d + 0.5))
        idf[w] = x if x > 0 else 1e-6
    want = []
    for task, terms in plans:
        score = {}
        for w in terms:
            for (s, m, x, size), tf in index.items():
                if x == w:
                    score[(s, m)] = score.get((s, m), 0) + idf[w] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
        best = sorted(score.items(), key=lambda i: (-round(i[1], 6), i[0][0] is not None, i[0][0] or 0, i[0][1] is not None, i[0][1] or ""))[:7]
        want += [(task, s, m, p, round(x, 6)) for p, ((s, m), x) in enumerate(best, 1)]
    assert sorted(((r.task_id, r.session, r.name, r.place, r.score) for r in got), key=lambda r: (r[0], r[3])) == want
    assert n < 6000  # some ten thousand pairs of a task and a message share a term


def test_a_block_counts_into_few_segments(monkeypatch):
    phrases = pytest.importorskip("tempograph.llm.phrases")
    import numpy as np

    bits, dice = 25, np.random.default_rng(1)

    class Lists:
        def __init__(self, batch):
            self.bucket, self.n = dice.integers(0, 1 << bits, 3000), dice.integers(0, 4, 3000)
            self.bucket[:40] = 77

        def buckets(self, bits):
            return self.bucket

        def own(self):
            return self.n

    blocks = [Lists(None) for _ in range(3)]
    monkeypatch.setattr(phrases, "_each", lambda batches, length: iter(blocks))
    width = phrases._width(bits)
    made = list(phrases._counted(1, bits, 5, width)(iter([])))
    assert sum(b.num_rows for b in made) <= 3 * 64  # it was one for each 65536 buckets, so rows grew with blocks times buckets
    rows = sorted((s, d) for b in made for s, d in zip(b["segment"].to_pylist(), b["packed"].to_pylist()))
    summed = phrases._summed(5, width)(iter([phrases._filled(phrases._COUNTS, len(rows), segment=[s for s, _ in rows], packed=[d for _, d in rows])]))
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for b in summed:
        for s, d in zip(b["segment"].to_pylist(), b["packed"].to_pylist()):
            flags[s * (width // 8) : (s + 1) * (width // 8)] = np.frombuffer(d, np.uint8)
    total = sum(np.minimum(np.bincount(x.bucket, x.n, 1 << bits), 5) for x in blocks)
    assert (np.unpackbits(flags) == (total >= 5)).all()
