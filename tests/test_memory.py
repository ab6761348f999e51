"""Keyword, fact and graph memory on worked conversations, and by loops over small random inputs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convrecall.functions import text as T
from convrecall.operators import coref, evaluation, facts as M, graph, keyword, vectors

FACT = "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, confidence double, evidence string"


def facts_of(spark, rows):
    df = spark.createDataFrame([(c, t, i, s, p, o, 0.9, f"{s} {p} {o}") for c, t, i, s, p, o in rows], FACT)
    return df.withColumn("fact_id", T.fact_id("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object"))


def test_bm25_worked(spark):
    rows = [
        ("1", 1, "My name is Alice and I work at OpenAI."), ("1", 3, "Actually, I work at Anthropic now."),
        ("2", 1, "I live in San Francisco and love espresso."), ("2", 3, "By the way I switched to oat milk."),
    ]
    docs = spark.createDataFrame(rows, "scope string, doc int, text string")
    asked = spark.createDataFrame([("q1", "1", "Where does Alice work now?"), ("q2", "2", "What city do I live in?"), ("q3", "1", " ")], "qid string, scope string, query string")
    got = [(r.qid, r.rank, r.doc, r.score) for r in keyword.bm25_retrieve(asked, docs, 5).orderBy("qid", "rank").collect()]
    assert got == [("q1", 1, 1, 0.8755), ("q1", 2, 3, 0.8755), ("q2", 1, 1, 0.6601)]


@pytest.mark.parametrize("seed", range(3))
def test_bm25_by_loop(spark, seed):
    rnd = random.Random(seed)
    docs = [(s, d, " ".join(rnd.choice("red green blue the of sky".split()) for _ in range(rnd.randrange(9)))) for s in "ab" for d in range(12)]
    asked = [(f"{s}{i}", s, " ".join(rnd.choice("red green blue the sky".split()) for _ in range(4))) for s in "ab" for i in range(4)]
    want = set()
    tokens = lambda t: [w for w in t.split() if w not in T.STOPWORDS]
    for qid, s, q in asked:
        own = [(d, Counter(tokens(t)), t) for s2, d, t in docs if s2 == s]
        avgdl = sum(sum(c.values()) for _, c, _ in own) / len(own) or 1
        scored = []
        for d, c, t in own:
            total = 0.0
            for w in tokens(q):
                df = sum(w in c2 for _, c2, _ in own)
                if c[w]:
                    total += math.log((len(own) - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl))
            if total and t != q:
                scored.append((-round(total, 9), d))
        want |= {(qid, k + 1, d) for k, (_, d) in enumerate(sorted(scored)[:3])}
    got = keyword.bm25_retrieve(
        spark.createDataFrame(asked, "qid string, scope string, query string"), spark.createDataFrame(docs, "scope string, doc int, text string"), 3
    )
    assert {(r.qid, r.rank, r.doc) for r in got.collect()} == want


def test_turns_are_filtered_and_deduplicated(spark):
    rows = [("c", 1, "user", "I like  tea"), ("c", 2, "assistant", "ok"), ("c", 3, "User", "I like tea "), ("c", 4, "user", "Really?"), ("c", 5, "user", None)]
    got = keyword.dedup_turns(keyword.user_turns(spark.createDataFrame(rows, "conv_id string, turn_id int, role string, text string")))
    assert [(r.turn_id, r.text) for r in got.collect()] == [(1, "I like tea")]


CHAT = [("c", 1, 0, "<USER>", "name", "Alice"), ("c", 1, 1, "<USER>", "works_at", "OpenAI"), ("c", 3, 0, "<USER>", "works_at", "Anthropic"),
        ("c", 5, 0, "Anthropic", "headquartered_in", "San Francisco")]


def test_graph_worked(spark):
    states = M.slot_states(M.retroactive_alias(facts_of(spark, CHAT)))
    assert {(r.object, r.active) for r in states.where("predicate = 'works_at'").collect()} == {("OpenAI", False), ("Anthropic", True)}
    nodes, edges = graph.build_graph(states)
    assert {r.node for r in nodes.collect()} == {"Alice", "OpenAI", "Anthropic", "San Francisco"} and edges.count() == 3
    asked = spark.createDataFrame([("q", "c", "Where does Alice work?")], "qid string, conv_id string, query string")
    got = graph.graph_retrieve(asked, states).orderBy("rank").collect()
    assert [(r.subject, r.predicate, r.hop, round(r.score, 6)) for r in got] == [
        ("Alice", "name", 0, 0.49225), ("Alice", "works_at", 0, 0.475107), ("Anthropic", "headquartered_in", 1, 0.340192),
    ]
    assert graph.graph_retrieve(asked, states, max_edges=1).count() == 1


def test_aliases(spark):
    df = facts_of(spark, CHAT)
    assert [r.subject for r in M.forward_alias(df).orderBy("turn_id", "fact_idx").collect()] == ["<USER>", "Alice", "Alice", "Anthropic"]
    assert [r.subject for r in M.retroactive_alias(df).orderBy("turn_id", "fact_idx").collect()] == ["Alice", "Alice", "Alice", "Anthropic"]


def test_as_of(spark):
    states = M.slot_states(facts_of(spark, CHAT))
    at = spark.createDataFrame([("a", "c", 2), ("b", "c", 3)], "qid string, conv_id string, at int")
    got = {(r.qid, r.object) for r in M.as_of(states, at).where("predicate = 'works_at'").collect()}
    assert got == {("a", "OpenAI"), ("b", "Anthropic")}


def test_pronouns(spark):
    rows = [("c", 1, 0, "Liam Chen", "works_at", "Nova Labs", "Liam Chen works at Nova Labs"), ("c", 2, 0, "he", "likes", "tea", "He likes tea"),
            ("c", 3, 0, "the office", "based_in", "Oslo", "The Nova Labs office is in Oslo"), ("c", 4, 0, "I", "name", "Ann", "I am Ann")]
    df = spark.createDataFrame([(*r[:6], r[6]) for r in rows], "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, text string")
    got = [r.subject for r in coref.repair(df.repartition(3)).orderBy("turn_id").collect()]
    # the newest entity answers a pronoun: Liam Chen and Nova Labs are of one turn, and the first mention comes first
    assert got[:3] == ["Liam Chen", "Liam Chen", "Nova Labs"]


def plain_fold(rows: list[dict]) -> list[str]:
    """Repaired subjects of one conversation's facts in their order, with everything looked at again at each turn."""
    alias: str | None = None
    seen: dict[str, int] = {}  # entity -> turn, in order of first mention
    cased: dict[str, str] = {}
    out: list[str] = []

    def canon(subject: str) -> str:
        low = subject.strip().lower()
        if low in coref.FIRST:
            return alias or "<USER>"
        return alias if alias and low == alias.lower() else subject

    i = 0
    while i < len(rows):
        turn = rows[i]["turn_id"]
        here = [r for r in rows[i:] if r["turn_id"] == turn]
        recent = [cased.get(e, e) for e, _ in sorted(seen.items(), key=lambda x: -x[1])]
        words = coref._tokens(here[0]["text"])
        repaired = []
        for r in here:
            subject = r["subject"] or ""
            low = subject.strip().lower()
            if low in coref.PRONOUNS:
                subject = alias or (recent[0] if recent else "<USER>")
            elif any(v in low for v in coref.VAGUE):
                subject = next((e for e in recent if coref._overlap(words, coref._tokens(e)) >= 0.2), subject)
            repaired.append(canon(subject))
        for subject, r in zip(repaired, here):
            seen[subject.lower()] = turn
            seen[(r["object"] or "").lower()] = turn
        for subject, r in zip(repaired, here):
            if r["predicate"] == "name" and (r["object"] or "").strip():
                name = r["object"].strip()
                alias = alias if alias and alias.lower() == name.lower() else name
                out = [alias if s.lower() == "<user>" else s for s in out]
                if "<user>" in seen:
                    seen[alias.lower()] = seen.pop("<user>")
                cased.pop("<user>", None)
            subject = canon(subject)
            out.append(subject)
            cased.setdefault(subject.lower(), subject)
            cased.setdefault((r["object"] or "").lower(), r["object"] or "")
            seen[subject.lower()] = turn
            seen[(r["object"] or "").lower()] = turn
        i += len(here)
    return out


TOLD = "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, text string"


def told(rnd, conv, turns):
    """Facts of a conversation in its order, with pronouns, vague heads, names in several casings and blanks."""
    subjects = ["me", "she", "they", "Ann", "ANN", "Nova Labs", "nova labs", "the office", "Nova team", "<USER>", "", None, "Bo"]
    rows = []
    for t in sorted(rnd.sample(range(turns * 2), turns)):
        text = rnd.choice(["the Nova Labs office", "ann and her team", "", None, "Bo headquarters of nova"])
        for i in range(rnd.randrange(1, 4)):
            p, o = rnd.choice([("likes", "tea"), ("name", "Ann"), ("name", " ANN "), ("name", "Bo"), ("name", " "), ("works_at", "Nova Labs"), ("likes", None), ("at", "<USER>")])
            rows.append((conv, t, i, rnd.choice(subjects), p if rnd.random() < 0.5 or p != "name" else "knows", o, text))
    return rows


def by_plain_fold(rows):
    named = [dict(zip(("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object", "text"), r)) for r in rows]
    return {(*r[:3],): s for r, s in zip(rows, plain_fold(named))}


def test_repairs_by_plain_fold(spark):
    rnd = random.Random(5)
    chats = [told(rnd, f"c{k}", rnd.randrange(1, 14)) for k in range(60)]
    want = {k: s for rows in chats for k, s in by_plain_fold(rows).items()}
    rows = [(*r, 7) for chat in chats for r in chat]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, TOLD + ", more int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # turns go on from batch to batch
    try:
        got = coref.repair(df)
        assert got.columns == df.columns
        assert {(r.conv_id, r.turn_id, r.fact_idx): r.subject for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert coref.repair(df.limit(0)).count() == 0


def test_repairs_of_nulls_and_long_conversations(spark):
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None), ("c", 1, 0, "me", "name", "Ann", None), ("c", None, 0, "i", "likes", "tea", None)], TOLD)
    got = {(r.conv_id, r.turn_id): r.subject for r in coref.repair(nulls).collect()}
    assert got == {(None, None): "", ("c", 1): "Ann", ("c", None): "Ann"}
    # 60,000 facts, all of them waiting for the name in the last one
    n = F.col("id").cast("int")
    long = spark.range(60_000).select(F.lit("c").alias("conv_id"), n.alias("turn_id"), F.lit(0).alias("fact_idx"), F.lit("<USER>").alias("subject"),
        F.when(n == 59_999, "name").otherwise("likes").alias("predicate"), F.when(n == 59_999, "Ann").otherwise(F.concat(F.lit("thing"), n)).alias("object"), F.lit("x").alias("text"))
    assert [tuple(r) for r in coref.repair(long).groupBy("subject").count().collect()] == [("Ann", 60_000)]


def test_metrics_worked(spark):
    rows = [("q", 1, "a x"), ("q", 2, "b"), ("q", 3, "c x")]
    results = spark.createDataFrame(rows, "qid string, rank int, text string").select(
        "*", *[F.lit("").alias(c) for c in ("subject", "predicate", "object")], F.lit("chunk").alias("type"), F.lit(None).cast("string").alias("id")
    )
    probes = spark.createDataFrame([("q", "x", ["x"]), ("none", "", [])], "qid string, expected string, relevant_texts array<string>")
    got = {r.qid: r for r in evaluation.evaluate(results, probes, 5).collect()}
    q = got["q"]
    assert (q.hits, q.precision, q.recall, q.rr, q.rank, q.em) == (2, 0.4, 1.0, 1.0, 1, 0)
    assert q.ap == pytest.approx((1 + 2 / 3) / 2) and q.ndcg == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert (got["none"].hits, got["none"].em, got["none"].retrieved) == (0, 1, 0)  # nothing expected, nothing found
    assert evaluation.macro(evaluation.evaluate(results.limit(0), probes.limit(0), 5)).first()["count"] == 0


def test_knn_and_upsert(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = vectors.knn(df.where("id < 4").select(F.col("id").alias("qid"), "v"), df, 5, block=9)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(q, i, k + 1) for q in range(4) for k, (_, i) in enumerate(sorted((-round(dot(rows[q][1], v), 9), i) for i, v in rows)[:5])}
    assert {(r.qid, r.id, r.rank) for r in got.collect()} == want
    old = spark.createDataFrame([("a", 1), ("b", 1)], "key string, n int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "key string, n int")
    assert {tuple(r) for r in vectors.upsert(old, new, "key", "n").collect()} == {("a", 1), ("b", 3), ("c", 2)}


@pytest.mark.parametrize("block", [4, 4096])
def test_prefiltered_vectors_of_any_kind(spark, monkeypatch, block):
    """Conversations are compared in blocks, never pair by pair; rows are those of a loop, odd vectors included."""
    monkeypatch.setattr(vectors.knn, "__defaults__", ("cosine", block, ()))
    rnd, nan = random.Random(3), float("nan")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [1.0], [2.0], [1.0, 2.0, 3.0]]
    made = [[float(rnd.randrange(-2, 3)), float(rnd.randrange(-2, 3))] for _ in range(40)]
    rows = [(i, rnd.choice(["a", "a", "b", None]), v) for i, v in enumerate(made + odd * 2)] + [(100 + i, "c", v) for i, v in enumerate(odd[:4] + made[:1])]
    df = spark.createDataFrame(rows, "fact_id long, conv_id string, v array<double>")
    text = F.col("fact_id").cast("string")
    states = df.select("fact_id", "conv_id", *[text.alias(c) for c in ("subject", "predicate", "object", "evidence")], (F.col("fact_id") % 3 != 0).alias("active"))
    got = vectors.vector_retrieve(df.select(F.col("fact_id").alias("qid"), "conv_id", "v"), states, df.select("fact_id", "v"), 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "zip_with" not in plan

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        scale = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 0.0 if scale == 0 else sum(x * y for x, y in zip(a, b)) / scale

    def order(x):  # not a number is the greatest; none comes last
        return (x[0] is None, 0 if x[0] is None or x[0] != x[0] else 1, 0 if x[0] is None or x[0] != x[0] else -round(x[0], 9), x[1])

    want = set()
    for q, c, v in rows:
        found = [(cosine(v, w), i) for i, d, w in rows if c is not None and c == d and i % 3]
        want |= {(q, k + 1, i, None if s is None else str(round(s, 6) + 0.0)) for k, (s, i) in enumerate(sorted(found, key=order)[:4])}
    assert {(r.qid, r["rank"], r.fact_id, None if r.score is None else str(r.score + 0.0)) for r in got.collect()} == want


def test_embedding_each_text_once(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    got = vectors.embed_batch(df, vectors.hashing_embedder(8)).collect()
    assert len(got) == 4 and sum(r.embedding is None for r in got) == 1 and len({tuple(r.embedding) for r in got if r.embedding}) == 2


def test_extracted_facts(spark):
    import json

    turns = spark.createDataFrame([("c", 1, "I like tea"), ("c", 2, "hm"), ("c", 3, None)], "conv_id string, turn_id int, text string")

    def extractor(texts):
        return texts.map(lambda t: json.dumps([{"subject": "I", "predicate": "likes", "object": t[7:], "source_span": t}]) if t and t.startswith("I like") else "[]")

    rows = M.parse_replies_plain(M.extract_facts(turns, extractor)).collect()
    assert [(r.turn_id, r.subject, r.object, r.confidence) for r in rows] == [(1, "I", "tea", 0.85)]


def test_payloads_and_chunks(spark):
    good = '[{"subject": "a", "predicate": "love", "object": "b", "confidence": "0.5", "fact_id": "f1", "note": "n"}, {"subject": "", "predicate": "p", "object": "o"}]'
    df = spark.createDataFrame([("c", 1, good), ("c", 2, "[1]"), ("c", 3, None), ("c", 4, "{")], "conv_id string, turn_id int, payload string")
    rows = M.coerce_payload(df).collect()
    assert [(r.predicate, r.confidence, r.fact_id, r.meta) for r in rows] == [("likes", 0.5, "f1", {"note": "n"})]
    chunks = spark.createDataFrame([("a", "t", [1.0, 2.0]), ("", "t", None), ("b", "t", [float("nan"), 1.0]), ("c", "t", [1.0])], "chunk_id string, text string, embedding array<double>")
    assert [r.chunk_id for r in chunks.where(M.valid_chunk(2)).collect()] == ["a"]


def test_the_same_rows_however_they_are_dealt(spark):
    df = M.slot_states(M.retroactive_alias(facts_of(spark, CHAT)))
    again = M.slot_states(M.retroactive_alias(facts_of(spark, CHAT[::-1]).repartition(8)))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(df.select(sorted(df.columns))) == key(again.select(sorted(df.columns)))


@pytest.mark.parametrize("seed", range(3))
def test_as_of_by_loop(spark, seed):
    rnd = random.Random(seed)
    span = rnd.choice([3, 40, 1000])
    states = [(rnd.choice("ab"), rnd.choice([None, rnd.randrange(-5, span)]), rnd.choice([None, rnd.randrange(-5, span + 9)]), f"f{i}") for i in range(150)]
    moments = [(f"q{i}", rnd.choice("abc"), rnd.choice([None, rnd.randrange(-9, span + 9)])) for i in range(60)]
    rows = spark.createDataFrame(states, "conv_id string, turn_id int, valid_to int, fact_id string").withColumn("level", F.lit("mine"))
    got = M.as_of(rows, spark.createDataFrame(moments, "qid string, conv_id string, at int"))
    want = [(q, f) for q, c, at in moments for d, a, b, f in states if c == d and at is not None and a is not None and a <= at and (b is None or at < b)]
    assert sorted((r.qid, r.fact_id) for r in got.collect()) == sorted(want) and "level" in got.columns
    assert M.as_of(rows, spark.createDataFrame(moments, "qid string, conv_id string, at int").limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 7, 30, 500])
def test_visits_by_loop(spark, most):
    """The walk of each seed, step by step, until the budget is used; a hub among the nodes."""
    rnd = random.Random(most)
    names = [f"n{i:02}" for i in range(25)]
    rows = [("c", rnd.randrange(9), i, rnd.choice(names), rnd.choice([*names, "n00", "n00", "n00"]), f"f{i}") for i in range(90)]
    edges = spark.createDataFrame(rows, "conv_id string, turn_id int, fact_idx int, src string, dst string, fact_id string")
    nodes = spark.createDataFrame([("c", n) for n in [*names, "alone"]], "conv_id string, node string")
    asked = [("q", "c", "n03", 1), ("q", "c", "none", 2), ("q", "c", "n00", 3), ("r", "c", "alone", 1), ("r", "c", "n07", 2), ("s", "other", "n01", 1)]
    want = []
    for q in "qrs":
        seen = []
        for _, conv, seed, _ in sorted((x for x in asked if x[0] == q), key=lambda x: x[3]):
            dist = {seed: 0} if conv == "c" and seed in [*names, "alone"] else {}
            for step in (1, 2):
                for *_, s, d, _ in rows:
                    for a, b in ((s, d), (d, s)):
                        if dist.get(a) == step - 1:
                            dist.setdefault(b, step)
            for hop, node in sorted((h, n) for n, h in dist.items()):
                for end in (3, 4):
                    seen += [(q, x[5], hop) for x in sorted(rows, key=lambda x: (x[1], x[2])) if x[end] == node]
        want += seen[:most]
    got = graph.visits(spark.createDataFrame(asked, "qid string, conv_id string, seed string, place int"), nodes, edges, 2, most)
    assert sorted((r.qid, r.fact_id, r.hop) for r in got.collect()) == sorted(want)


def test_texts_are_read_once(spark, tmp_path):
    """One pass over the documents makes all that a search needs of them."""
    docs = spark.createDataFrame([("s", i, f"alpha w{i % 3} beta") for i in range(50)], "scope string, doc long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    read = spark.read.parquet(str(tmp_path / "docs")).mapInArrow(count, docs.schema)
    asked = spark.createDataFrame([("q", "s", "w2 beta"), ("r", "s", "alpha w1 beta")], "qid string, scope string, query string")
    assert keyword.bm25_retrieve(asked, read, 3).count() == 6 and seen.value == 50
