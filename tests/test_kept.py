"""Tables and indexes that are kept between batches, relevance over whole corpora, lineage of hot slots."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql.types import StructType

from convrecall.operators import bounded, evaluation, facts as M, keyword, qrels
from convrecall.operators.kept_index import KeptIndex
from convrecall.sources.keyed import KeyedTable
from convrecall.streaming import memory

KIND = StructType().add("key", "string").add("n", "long").add("v", "string")


def table(spark, path, **also):
    return KeyedTable(spark, str(path), KIND, ("key",), "n", **also)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_keyed_by_loop(spark, tmp_path):
    """Random batches with replays, deletions, late rows, nulls and compactions against a dictionary."""
    rnd, kept = random.Random(1), table(spark, tmp_path / "t", buckets=5)
    now, at = {}, {}
    assert kept.read().count() == 0
    for i in range(6):
        batch = [(rnd.choice([*"abcdefgh", None]), rnd.choice([None, *range(9)]), rnd.choice(["x", None, "y"]), rnd.choice([None, False, False, True])) for _ in range(rnd.choice([0, 6, 9]))]
        df = spark.createDataFrame(batch, "key string, n int, v string, gone boolean").withColumn("bucket", F.lit("mine"))
        best = {}
        for key, n, v, gone in batch:  # of a batch's rows of one key and order the greater value stays
            order = (n is not None, n or 0, v is not None, v or "")
            if key not in best or order > best[key][0]:
                best[key] = (order, n, v, bool(gone))
            elif order == best[key][0] and best[key][3] != bool(gone):
                best[key] = (order, n, v, None)  # either
        if any(b[3] is None for b in best.values()):
            continue
        assert kept.upsert(df, i, "gone") and not kept.upsert(df, i, "gone")
        for key, (order, n, v, gone) in best.items():
            if key not in at or order[:2] >= at[key]:
                at[key] = order[:2]
                now[key] = None if gone else (key, n, v)
        assert rows_of(kept.read()) == Counter(x for x in now.values() if x)
        if i % 2:
            before = rows_of(kept.read())
            kept.compact(1)
            # what is gone and compacted is forgotten, so that an older row of its key may come again
            for key in [k for k, x in now.items() if x is None]:
                del now[key], at[key]
            assert rows_of(kept.read()) == before and kept.vacuum(1) >= 0 and rows_of(kept.read()) == before


def test_batches_touch_their_buckets(spark, tmp_path):
    kept = table(spark, tmp_path / "t", buckets=16)
    kept.upsert(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], KIND), 0)
    before = {str(p): p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    kept.upsert(spark.createDataFrame([("k3", 2, "b")], KIND), 1)
    new = [p for p in Path(tmp_path).rglob("*.parquet") if str(p) not in before and "manifest" not in str(p)]
    assert len(new) == 1 and all(Path(p).stat().st_mtime_ns == t for p, t in before.items())
    found = kept.lookup(spark.createDataFrame([("k3",)], "key string"))
    assert 0 < found.count() < 60 and found.where("key = 'k3'").first().v == "b"
    assert {Path(p).parent.name for p in found.inputFiles()} == {new[0].parent.name}


@pytest.mark.parametrize("lost", ["manifest", "marker"])
def test_a_crash_leaves_the_table(spark, tmp_path, monkeypatch, lost):
    """A writer that is lost after its rows, or within the manifest, has changed nothing; its batch is brought again."""
    kept = table(spark, tmp_path / "t", buckets=4)
    kept.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], KIND), 0)
    old, batch = rows_of(kept.read()), spark.createDataFrame([("a", 2, "new")], KIND)
    with monkeypatch.context() as m:
        if lost == "manifest":
            m.setattr(KeyedTable, "_publish", lambda self, rows: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                kept.upsert(batch, 1)
        else:
            kept.upsert(batch, 1)
            (tmp_path / "t/manifest/v0000000002/_SUCCESS").unlink()
    assert rows_of(kept.read()) == old
    assert kept.upsert(batch, 1) and rows_of(kept.read()) == Counter([("a", 2, "new"), ("b", 1, "old")])
    assert rows_of(kept.read(1)) == old
    assert kept.vacuum(1) >= 1 and rows_of(kept.read()) == Counter([("a", 2, "new"), ("b", 1, "old")])


def test_sums(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL("key string, n long"), ("key",), buckets=3, sums=("n",))
    for i, batch in enumerate(([("a", 1), ("a", 2), ("b", 1)], [("a", -3), ("c", 5)], [("b", 4), ("c", 0)])):
        kept.upsert(spark.createDataFrame(batch, "key string, n int"), i)
    assert rows_of(kept.read()) == Counter([("b", 5), ("c", 5)])
    assert kept.compact(1) > 0 and kept.compact(1) == 0 and rows_of(kept.read()) == Counter([("b", 5), ("c", 5)])
    kept.upsert(spark.createDataFrame([("z", 1)], "key string, n int"), 0, writer="another")
    assert kept.taken() == 2 and kept.taken("another") == 0 and kept.read().count() == 3


def test_streamed_table(spark, tmp_path):
    for i, batch in enumerate(([("a", 1, "x"), ("b", 1, "x")], [("a", 3, "y")], [("a", 2, "late"), ("c", 1, "x")])):
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = table(spark, tmp_path / "t", buckets=4)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(memory.keyed_sink(kept, most=1)).start().awaitTermination()
    assert rows_of(kept.read()) == Counter([("a", 3, "y"), ("b", 1, "x"), ("c", 1, "x")])


def index_rows(index):
    terms = Counter((r.scope, r.term, r.df) for r in index.terms.collect())
    stats = {r.scope: (r.n, round(r.avgdl, 9)) for r in index.stats.collect()}
    return terms, stats, Counter((r.scope, r.doc, r.length) for r in index.docs.collect()), Counter((r.scope, r.doc, r.term, r.tf) for r in index.postings.collect())


def test_kept_index_by_batch_index(spark, tmp_path):
    """Any batches, replays and losses half-way: the index is that of the documents there are."""
    rnd, index = random.Random(2), KeptIndex(spark, str(tmp_path / "i"), buckets=4)
    words = ["the", "alpha", "beta", "gamma", "delta", "été", "x1"]
    kind, now = "scope string, doc int, at int, text string, deleted boolean", {}
    for i in range(5):
        batch = {}
        for _ in range(12):
            key = (rnd.choice("st"), rnd.randrange(8))
            batch[key] = (*key, rnd.randrange(1, 6), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randrange(9)))]), rnd.random() < 0.2)
        rows = [*batch.values(), (None, 1, 1, "no scope", False), ("s", None, 1, "no doc", False)]
        df = spark.createDataFrame(rows, kind).withColumn("term", F.lit("mine"))
        if i == 3:  # lost between two of its tables, and brought again
            whole = KeyedTable.upsert
            KeyedTable.upsert = lambda self, *a, **b: whole(self, *a, **b) if not self.path.endswith("docs") else (_ for _ in ()).throw(OSError("lost"))
            before = index_rows(index.open())
            try:
                with pytest.raises(OSError):
                    index.update(df, i)
            finally:
                KeyedTable.upsert = whole
            assert index_rows(index.open()) == before  # readers see the state before
        assert index.update(df, i) and not index.update(df, i)
        for key, row in batch.items():
            if key not in now or row[2] >= now[key][2]:
                now[key] = row
        for key in [k for k, r in now.items() if r[4]]:
            del now[key]  # tombstones have an order too, but ``at`` of what comes back is checked against rows alone
        docs = spark.createDataFrame([(s, d, t or "") for s, d, _, t, _ in now.values()], "scope string, doc long, text string")
        assert index_rows(index.open()) == index_rows(keyword.bm25_index(docs)), i
        if i == 2:
            assert index.compact(1) > 0 and index_rows(index.open()) == index_rows(keyword.bm25_index(docs))


def test_streamed_index(spark, tmp_path):
    rows = [("s", i, 1, f"alpha w{i % 3} beta", False) for i in range(9)] + [("t", 1, 1, "alpha", False)]
    kind = "scope string, doc long, at long, text string, deleted boolean"
    for part in (rows[:4], rows[4:], [("s", 0, 2, "other words", False), ("s", 1, 2, None, True)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = KeptIndex(spark, str(tmp_path / "i"), buckets=4)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(memory.index_sink(index, most=1)).start().awaitTermination()
    docs = spark.createDataFrame([(s, d, t) for s, d, _, t, _ in rows if (s, d) not in (("s", 0), ("s", 1))] + [("s", 0, "other words")], "scope string, doc long, text string")
    assert index_rows(index.open()) == index_rows(keyword.bm25_index(docs))
    asked = spark.createDataFrame([("q", "s", "w2 alpha")], "qid string, scope string, query string")
    ranked = lambda df: df.orderBy("qid", "rank").collect()
    assert ranked(keyword.bm25_retrieve(asked, docs, 3, index=index.open())) == ranked(keyword.bm25_retrieve(asked, docs, 3))


def test_empty_index(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "i"))
    assert index.open().postings.count() == index.open().stats.count() == 0
    index.update(spark.createDataFrame([], "scope string, doc long, at long, text string"), 0)
    assert index.open().docs.count() == 0 and index.seal()
    assert index.open().blocks.lists.count() == 0


def test_removed_documents_stay_removed(spark, tmp_path):
    """What is older than a removal changes nothing, neither documents nor frequencies."""
    index, kind = KeptIndex(spark, str(tmp_path / "i"), buckets=2), "scope string, doc long, at long, text string, deleted boolean"
    for i, row in enumerate([("s", 1, 5, None, True), ("s", 1, 3, "late alpha", False), ("s", 2, 1, "alpha beta", False), ("s", 2, 4, None, True), ("s", 2, 4, "beta", False), ("s", 2, None, "x", False)]):
        index.update(spark.createDataFrame([row], kind), i)
    assert index_rows(index.open()) == index_rows(keyword.bm25_index(spark.createDataFrame([("s", 2, "beta")], "scope string, doc long, text string")))


def test_little_is_shuffled_and_left(spark, tmp_path):
    """Buckets of one folder are read as they are, an update leaves no table beside the index, and a vacuum only what is shown."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    docs = spark.range(60).selectExpr("'s' as scope", "id as doc", "1L as at", "concat('b a b w', id % 7, ' ', repeat('x ', cast(id % 3 as int))) as text")
    index, before = KeptIndex(spark, str(tmp_path / "i"), buckets=2), {*shared.glob("table-*")}
    index.update(docs, 0)
    assert {*shared.glob("table-*")} == before
    assert "Window" not in index.docs.read()._jdf.queryExecution().optimizedPlan().toString()
    later = docs.where("doc < 20").withColumns({"at": F.lit(2), "text": F.lit("other words")})
    index.update(later.unionByName(later.withColumn("text", F.lit("but"))), 1)  # of repeated rows the greater text stays
    index.compact(1)
    assert index.vacuum() > 0 and index.vacuum() == 0
    now = later.unionByName(docs.where("doc >= 20"))
    opened, asked = index.open(), spark.createDataFrame([("q", "s", "b w3 other")], "qid string, scope string, query string")
    assert index_rows(opened) == index_rows(keyword.bm25_index(now))
    assert rows_of(keyword.bm25_retrieve(asked, now, 5, index=opened)) == rows_of(keyword.bm25_retrieve(asked, now, 5))


# blocks with bounds


@pytest.mark.parametrize("seed", range(2))
def test_blocks_by_all_postings(spark, tmp_path, seed):
    """Searches through blocks give the rows of a search of all postings: before and after changes, ties and own texts included."""
    rnd, index = random.Random(seed), KeptIndex(spark, str(tmp_path / "i"), buckets=3)
    words, now = [*"abcdefghij", "the", "été"], {}
    kind = "scope string, doc long, at long, text string, deleted boolean"

    def batch(n, at):
        rows = {}
        for _ in range(n):
            key = (rnd.choice("ssst"), rnd.randrange(60))
            text = rnd.choice([None, "", " ".join(w + "x" for w in rnd.choices(words, weights=range(len(words), 0, -1), k=rnd.randrange(1, 25)))])
            rows[key] = (*key, at, text, rnd.random() < (0.2 if at else 0))
        now.update({key: row for key, row in rows.items()})
        index.update(spark.createDataFrame([*rows.values()], kind).withColumn("block", F.lit("mine")), at)

    def compare():
        docs = spark.createDataFrame([(s, d, t or "") for s, d, _, t, gone in now.values() if not gone], "scope string, doc long, text string")
        own = [(f"own{i}", r.scope, r.text) for i, r in enumerate(docs.limit(3).collect())]
        asked = [(f"q{i}", rnd.choice("stu"), " ".join(w + "x" for w in rnd.choices(words, k=rnd.randrange(1, 5)))) for i in range(8)] + [("none", "s", None), (None, "s", "ax")]
        queries, k = spark.createDataFrame(asked + own, "qid string, scope string, query string"), rnd.choice([0, 1, 3, 40])
        opened = index.open()
        got = [tuple(r)[:6] for r in keyword.bm25_retrieve(queries, docs, k, index=opened).orderBy("qid", "rank").collect()]
        want = [tuple(r)[:6] for r in keyword.bm25_retrieve(queries, docs, k).orderBy("qid", "rank").collect()]
        assert got == want and want
        return opened

    batch(80, 0)
    assert compare().blocks is None and index.seal(size=4) and not index.seal(size=4)
    assert compare().blocks.changed.count() == 0
    batch(15, 1)
    assert compare().blocks.changed.count() > 0
    index.compact(1, size=4)
    assert compare().blocks.changed.count() == 0
    batch(9, 2)
    index.docs.compact(1)  # beside the index
    batch(2, 3)
    assert compare().blocks is None and index.seal(size=4) and compare().blocks is not None


def test_blocks_are_skipped(spark, tmp_path):
    """A word that every document has is read in the few blocks that can hold a better answer than those found."""
    docs = spark.range(2000).selectExpr("'s' as scope", "id as doc", "1L as at", "concat('common ', repeat('filler ', cast(id % 7 as int)), if(id % 100 = 3, 'rare', concat('w', id))) as text")
    index = KeptIndex(spark, str(tmp_path / "i"), buckets=2)
    index.update(docs, 0)
    index.seal(size=16)
    opened = index.open()
    queries = spark.createDataFrame([("q", "s", "common rare")], "qid string, scope string, query string")
    parts = keyword.weighted_terms(queries, opened)
    upper = bounded.upper_bounds(parts, opened.blocks.lists, 1.5, 0.75)
    scores = keyword.bm25_score(queries, opened)
    floor = spark.createDataFrame([("q", scores.orderBy(F.desc("score")).collect()[4].score)], "qid string, floor double")
    first = bounded.best_blocks(upper, 10)
    read = first.unionByName(bounded.rest_of_blocks(upper, first, floor))
    n, every = bounded.read_blocks(parts, opened.blocks, read).count(), opened.postings.where("term in ('common', 'rare')").count()
    assert every == 2020 and n < every / 4
    most = scores.join(opened.blocks.lists.select("block", F.explode("list.doc").alias("doc")).distinct(), "doc").join(upper.select("block", "upper"), "block")
    assert most.where("score > upper + 1e-9").count() == 0 and most.count() == 2000
    assert rows_of(keyword.bm25_retrieve(queries, docs, 5, index=opened)) == rows_of(keyword.bm25_retrieve(queries, docs, 5))


# relevance


@pytest.mark.parametrize("seed", range(3))
def test_containment_by_loop(spark, seed):
    """Few letters, so that words meet as parts of words, at both ends and across spaces."""
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("aab b c\n.é") for _ in range(n))
    texts = [(rnd.choice("st"), i % 25, rnd.choice([None, some(rnd.randrange(40))])) for i in range(40)] + [("s", 99, "abc" * 2000), (None, 98, "a b"), ("s", 97, "x")]
    needles = [(rnd.choice("st"), some(rnd.randrange(1, 8))) for _ in range(60)] + [("s", "cabcab"), ("s", None), ("s", ""), ("u", "a"), (None, "a"), ("s", "zz"), ("s", "a  b"), ("s", " ")]
    needles += [(s, t[1:-1]) for s, _, t in texts[:10] if t and len(t) > 4]
    got = qrels.containment(spark.createDataFrame(needles, "scope string, needle string"), spark.createDataFrame(texts, "scope string, doc long, text string").withColumn("token", F.lit("mine")))
    want = {(s, n, d) for s, n in needles for o, d, t in texts if s and s == o and n and n.strip(" ") and t is not None and n in t}
    assert Counter(map(tuple, got.collect())) == Counter(want) and want


def test_containment_of_nothing(spark):
    none, some = spark.createDataFrame([], "scope string, needle string"), spark.createDataFrame([("s", 1, "a")], "scope string, doc long, text string")
    assert qrels.containment(none, some).count() == 0
    assert qrels.containment(spark.createDataFrame([("s", "a")], "scope string, needle string"), some.limit(0)).count() == 0


def test_recall_of_a_corpus(spark):
    """Four documents hold the answer; two are found."""
    docs = spark.createDataFrame([("s", i, t, o) for i, (t, o) in enumerate([("in Oslo.", ""), ("OSLO it is", ""), ("no", " oslo "), ("none", "x"), ("I live there now", ""), ("else", "")])], "scope string, doc long, text string, object string")
    probes = spark.createDataFrame([("q", "s", " Oslo", ["i live there"]), ("r", "s", "", [None, ""]), ("t", "other", "oslo", None)], "qid string, scope string, expected string, relevant_texts array<string>")
    pairs = qrels.corpus_qrels(probes, docs)
    assert Counter(map(tuple, pairs.collect())) == Counter([("q", 0), ("q", 1), ("q", 2), ("q", 4)])
    found = docs.where("doc in (0, 3, 4)").select(F.lit("q").alias("qid"), F.row_number().over(Window.orderBy("doc")).alias("rank"), F.lit("chunk").alias("type"), F.col("doc").cast("string").alias("id"),
                                                  "text", F.lit("").alias("subject"), F.lit("").alias("predicate"), "object")
    rows = {r.qid: r for r in evaluation.evaluate(found, probes, 3, qrels.totals(pairs)).collect()}
    assert rows["q"].hits == 2 and rows["q"].recall == 0.5 and abs(rows["q"].ap - (1 + 2 / 3) / 4) < 1e-9
    assert rows["r"].recall == rows["t"].recall == 0
    assert {r.qid: r.recall for r in evaluation.evaluate(found, probes, 3).collect()}["q"] == 1


# lineage


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_one_slot_of_all_rows(spark, parts):
    rnd = random.Random(parts)
    rows = [(f"c{rnd.randrange(5)}", rnd.randrange(50), 0, i, "me", "likes", str(i), f"f{i if rnd.random() < 0.9 else rnd.randrange(100)}") for i in range(400)]
    rows += [("c", 1, 0, 1000 + i, "me", f"p{i % 3}", "x", f"g{i}") for i in range(5)] + [("c", 2, 0, None, "me", "likes", "x", "h")]
    facts = spark.createDataFrame(rows, "conv_id string, turn_id int, fact_idx int, ingest_seq long, subject string, predicate string, object string, fact_id string").repartition(3)
    slot, order = ["subject", "predicate"], ["ingest_seq", "turn_id", "fact_idx"]
    last = Window.partitionBy(*slot, "fact_id").orderBy(*[F.desc(c) for c in order])
    w = Window.partitionBy(*slot).orderBy(*order)
    once = facts.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")
    want = once.withColumns({"active": F.lead("fact_id").over(w).isNull(), "supersedes": F.lag("fact_id").over(w), "valid_to": F.lead("turn_id").over(w)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = M.slot_states(facts, "global").select(*want.columns)
        assert rows_of(got) == rows_of(want)
        assert M.slot_states(facts.limit(0), "global").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_range_holds_a_part_of_a_slot(spark):
    """No window but that over the ends of ranges goes over more than a range of the hot slot."""
    facts = spark.range(4000).select(F.lit("c").alias("conv_id"), F.lit(1).alias("turn_id"), F.lit(0).alias("fact_idx"), F.col("id").alias("ingest_seq"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"),
                                     F.lit("o").alias("object"), F.concat(F.lit("f"), "id").alias("fact_id"))
    made = M.slot_states(facts, "global")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    over = [line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(" in line]
    assert all("fact_id" in x or "range__s" in x for x in over) and made.where("active").count() == 1


# event time


def test_event_time_by_loop(spark, tmp_path):
    """Random batches with late and repeated rows, each brought twice and one lost half-way, against a plain loop; also as a stream."""
    from datetime import datetime, timedelta

    from convrecall.streaming.eventtime import EventTime

    rnd, kind = random.Random(4), StructType().add("user", "string").add("ts", "timestamp").add("n", "long")
    base, delay, sinks = datetime(2024, 1, 1), 60, [EventTime(spark, str(tmp_path / x), kind, ("user",), "ts", 60, ("n",), 3) for x in "ab"]
    seen, latest, want, late, n = {}, None, [], [], 0
    for i in range(5):
        batch = []
        for _ in range(15):
            n += 1
            batch.append((rnd.choice(["a", "b", "c", None]), rnd.choice([None, *[base + timedelta(seconds=40 * i + rnd.randrange(-150, 40)) for _ in range(6)]]), n))
        mark = None if latest is None else latest - timedelta(seconds=delay)
        late += [(x[2], i) for x in batch if x[1] is None or (mark and x[1] < mark)]
        for user, ts, k in sorted((x for x in batch if x[1] is not None and not (mark and x[1] < mark)), key=lambda x: (x[1], x[2])):
            if user not in seen or (mark and seen[user][0] < mark and seen[user][1] != i):
                want.append((k, i))
                seen[user] = (ts, i)
        latest = max([latest or base - timedelta(days=1), *(x[1] for x in batch if x[1])])
        df = spark.createDataFrame(batch, kind)
        if i == 3:
            whole = KeyedTable.upsert
            KeyedTable.upsert = lambda self, *a, **b: whole(self, *a, **b) if not self.path.endswith("marks") else (_ for _ in ()).throw(OSError("lost"))
            try:
                with pytest.raises(OSError):
                    sinks[0](df, i)
            finally:
                KeyedTable.upsert = whole
        sinks[0](df, i)
        sinks[0](df, i)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(sinks[1]).start().awaitTermination()
    for sink in sinks:
        assert sorted((r.n, r.batch) for r in sink.rows().collect()) == sorted(want)
        assert sorted((r.n, r.batch) for r in sink.late().collect()) == sorted(late)
