"""Readers, curation and streams."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from convrecall.operators import curate, facts as M, keyword
from convrecall.plans import inputs
from convrecall.sources import concatenated, conversations as S
from convrecall.streaming import memory, repair_state
from tests.test_memory import TOLD, by_plain_fold, told

SF = "/root/testdata/sf0.001"
ROW = {"conversation_id": "c1", "scenario": " Simple", "difficulty": "EASY", "turns": [{"role": "User", "content": " I live in Oslo. "}, {"role": "assistant", "content": "ok"},
       {"role": "user", "content": "Where do I live?"}], "eval": [{"question": "Where did I go", "expected_answer": " Oslo", "relevant_texts": ["I live in Oslo."]}]}


@pytest.mark.parametrize("form", ["lines", "array", "concatenated"])
def test_forms(spark, tmp_path, form):
    rows = [ROW, {**ROW, "conversation_id": "c2"}]
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows, indent=1), "concatenated": "".join(map(json.dumps, rows))}[form]
    (tmp_path / "x.json").write_text(text)
    df = S.read_conversations(spark, str(tmp_path / "x.json"), form)
    assert sorted(r.conversation_id for r in df.collect()) == ["c1", "c2"]
    assert S.explode_turns(df).count() == 6
    assert {r.qid for r in S.explode_probes(df).collect()} == {"c1::1", "c2::1"}


def by_characters(text):
    """Top-level objects by one walk over the bytes; what is open at the end is given as it is."""
    out, depth, inside, slashes, begin = [], 0, False, 0, None
    for at, c in enumerate(text):
        if c == ord('"') and slashes % 2 == 0:
            inside = not inside
        elif c == ord("{") and not inside:
            depth += 1
            begin = at if depth == 1 else begin
        elif c == ord("}") and not inside:
            if depth == 1:
                out.append(text[begin : at + 1])
            depth = max(0, depth - 1)
        slashes = slashes + 1 if c == ord("\\") else 0
    return out + ([text[begin:]] if depth else [])


@pytest.mark.parametrize("seed", range(40))
def test_objects_in_ranges_by_walk(tmp_path, monkeypatch, seed):
    """Ranges and pieces of few bytes, cut inside strings, escapes and objects, of sound and of broken texts."""
    rnd = random.Random(seed)
    monkeypatch.setattr(concatenated, "PIECE", rnd.choice([1, 3, 16, 1000]))
    signs = ['{', '}', '"', "\\", "a", "é", "[", " "]
    sound = [json.dumps({"a": "".join(rnd.choices(signs, k=rnd.randrange(9))), "b": [{"c": {}}] * rnd.randrange(3)}) for _ in range(30)]
    text = (rnd.choice(["", "\n", ", "]).join(sound) if seed % 2 else "".join(rnd.choices(signs, k=300))).encode()
    path, wide = tmp_path / "x.json", rnd.choice([1, 7, 64, 5000])
    path.write_bytes(text)
    got, inside, depth = [], 0, 0
    for start in range(0, len(text), wide):
        own = (f"file:{path}", start, min(start + wide, len(text)))
        got += concatenated._read(*own, inside, depth, 1 << 20)
        flips, *both = concatenated._summed(*own)
        rise, low = both[2 * inside : 2 * inside + 2]
        inside, depth = (inside + flips) % 2, max(depth + rise, rise - low)
    assert got == by_characters(text)
    assert list(concatenated.objects(iter([text]))) == got
    if seed % 2:
        assert got == [x.encode() for x in sound]


def test_large_files_are_split(spark, tmp_path):
    """Many ranges of plain files, names with blanks, a compressed file, an empty one, and objects that are too long or never end."""
    rows = [json.dumps({**ROW, "conversation_id": f"c{i}", "scenario": 'a } " { \\' * (i % 7)}) for i in range(60)]
    folder = tmp_path / "some files"
    folder.mkdir()
    (folder / "a b.json").write_text("".join(rows[:40]) + '{"conversation_id": "never')
    (folder / "c.json.gz").write_bytes(gzip.compress("".join(rows[40:]).encode()))
    (folder / "d.json").write_text("")
    found = concatenated.read_objects(spark, str(folder), range_bytes=200)
    assert sorted(r.value for r in found.collect()) == sorted([*rows, '{"conversation_id": "never'])
    kept = S.read_conversations(spark, str(folder), "concatenated")
    assert {r.conversation_id for r in kept.where("corrupt is null").collect()} == {f"c{i}" for i in range(60)}
    assert [r.corrupt for r in kept.where("corrupt is not null").collect()] == ['{"conversation_id": "never']
    long = list(concatenated.objects(iter([b'{"a": "', b"x" * 100, b'"}{"b": 1}']), longest=50))
    assert long[0].startswith(b'{"a": "x') and long[1:] == [b'{"b": 1}']


def test_validation(spark, tmp_path):
    rows = [ROW, {**ROW, "conversation_id": None}, {**ROW, "turns": [{"role": "system", "content": "x"}]}, {**ROW, "eval": []}, {**ROW, "turns": ROW["turns"][:2]}]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, rows)))
    good, bad = curate.split_valid(S.read_conversations(spark, str(tmp_path / "x.json")))
    kept = good.collect()
    assert len(kept) == 1 and kept[0]["eval"][0].question == "where do i live?" and kept[0]["eval"][0].relevant_texts == ["i live in oslo"]
    assert {r.reject_reason for r in bad.collect()} == {"no conversation_id", "invalid role", "no eval", "question not in user turns"}
    flags = curate.audit(good).first()
    assert flags.last_turn and flags.one_mark and flags.quoted and not flags.turn_count
    replies = good.select("conversation_id", "scenario", "difficulty", F.lit("ok " + json.dumps(ROW) + " bye").alias("reply"))
    assert curate.parse_generated(replies).first().reject_reason is None


def test_grid(spark):
    grid = curate.generation_grid(spark, 2)
    assert grid.count() == 18 and grid.where("conversation_id = 'SIMPLE_EASY_7_001'").count() == 1
    prompts = curate.generation_prompts(grid, "Write JSON.", "{scenario}, {difficulty}: {n_turns} turns as {conversation_id}", "m").where("conversation_id = 'SIMPLE_EASY_7_001'").first()
    assert (prompts.system, prompts.user, prompts.model) == ("Write JSON.", "simple, easy: 4-6 turns as SIMPLE_EASY_7_001", "m")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("k", "q", 1)], "system string, qid string, n int")
    S.write_results(df, df, df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/macro")).first().system == "k"
    facts = inputs.facts(spark, SF).limit(5)
    assert S.facts_from_json(S.facts_to_json(facts), facts.schema).count() == 5
    S.write_dataset(df, str(tmp_path / "log"))
    S.write_dataset(df, str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_reset(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    df.write.parquet(str(tmp_path / "t"))
    S.reset(df, str(tmp_path / "t"))
    left = spark.read.parquet(str(tmp_path / "t"))
    assert left.count() == 0 and left.columns == ["id", "name"]


def run(stream, mode):
    name = f"t{abs(hash(stream)) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_streamed_turns_equal_batch(spark, tmp_path):
    rows = inputs.turns(spark, SF).select(F.col("conv_id").cast("string").alias("conv_id"), "turn_id", "role", F.col("text").alias("content"))
    rows.unionByName(rows).repartition(3).write.json(str(tmp_path / "in"))
    got = run(memory.stream_docs(S.read_turn_stream(spark, str(tmp_path / "in"))), "append")
    want = keyword.dedup_turns(keyword.user_turns(rows.withColumnRenamed("content", "text")))
    assert {(r.conv_id, r.text) for r in got.collect()} == {(r.conv_id, r.text) for r in want.collect()}


def test_streamed_slots_equal_batch(spark, tmp_path):
    facts = inputs.facts(spark, SF).withColumn("conv_id", F.col("conv_id").cast("string"))
    facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    got = run(memory.stream_slots(stream), "update")
    now = {r.fact_id for r in got.where("active").collect()} - {r.fact_id for r in got.where("not active").collect()}
    assert now == {r.fact_id for r in M.slot_states(facts).where("active").collect()}


def test_streamed_repairs(spark, tmp_path):
    kind = "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, text string"
    spark.createDataFrame([("c", 1, 0, "me", "likes", "tea", "")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(memory.stream_repaired(stream), "update").collect()
    assert [(r.turn_id, r.subject, r.late) for r in got] == [(1, "<USER>", False)]


def test_streamed_repairs_equal_batch(spark, tmp_path):
    rnd = random.Random(6)
    for k in range(12):
        rows, folder = told(rnd, "c", 9), tmp_path / str(k)
        at = sorted(rnd.sample(range(1, len(rows)), 3))  # also in the midst of turns
        for part in (rows[i:j] for i, j in zip([0, *at], [*at, len(rows)])):
            spark.createDataFrame(part, TOLD).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 1).parquet(str(folder))
        now = {}
        query = stream_to(now, memory.stream_repaired(stream))
        assert now == by_plain_fold(rows), query


def test_keyed_repairs_equal_batch(spark, tmp_path):
    """State by keys: conversations together in a stream, cut into micro-batches also in the midst of turns."""
    rnd = random.Random(8)
    told_of = {c: told(rnd, c, 9) for c in (f"c{k}" for k in range(12))}
    cuts = {c: [0, *sorted(rnd.sample(range(1, len(rows)), 3)), len(rows)] for c, rows in told_of.items()}
    for b in range(4):
        part = [x for c, rows in told_of.items() for x in rows[cuts[c][b] : cuts[c][b + 1]]]
        spark.createDataFrame(part, TOLD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, now = spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), {}
    with repair_state.rocksdb(spark):
        query = stream_to(now, repair_state.stream_repaired_keyed(stream))
    assert len(query.recentProgress) >= 4
    assert now == {k: v for rows in told_of.values() for k, v in by_plain_fold(rows).items()}


def test_keyed_repairs_of_nulls_and_late_facts(spark, tmp_path):
    old = [("c", 2, 0, "me", "likes", "tea", ""), ("d", None, None, None, None, None, None), (None, 1, 0, "He", "is", "in", "x")]
    new = [("c", 1, 0, "me", "likes", "ink", ""), ("c", 3, 0, "me", "name", "Ann", "")]
    for rows in (old, new):
        spark.createDataFrame(rows, TOLD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, out = spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), []
    with repair_state.rocksdb(spark):
        take = lambda batch, _: out.append(sorted(batch.collect(), key=str))
        repair_state.stream_repaired_keyed(stream).writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    first, second = ([(r.conv_id, r.turn_id, r.subject, r.object, r.late) for r in rows] for rows in out if rows)
    assert set(first) == {("c", 2, "<USER>", "tea", False), ("d", -1, "", None, False), (None, 1, "<USER>", "in", False)}
    assert set(second) == {("c", 1, "me", "ink", True), ("c", 2, "Ann", "tea", False), ("c", 3, "Ann", "Ann", False)}


def stream_to(now, stream):
    """Run a stream and keep the last subject that comes out for each fact."""

    def take(batch, batch_id):
        for r in batch.collect():
            assert not r.late
            now[r.conv_id, r.turn_id, r.fact_idx] = r.subject

    query = stream.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return query


def test_upserts_replay(spark, tmp_path):
    write = memory.upsert_sink(str(tmp_path / "t"), "key", "n")
    a = spark.createDataFrame([("x", 1)], "key string, n int")
    b = spark.createDataFrame([("x", 2), ("y", 1)], "key string, n int")
    for df, k in ((a, 3), (b, 5), (b, 5)):  # a first batch of any number
        write(df, k)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v5")).collect()} == {("x", 2), ("y", 1)}
