"""Text functions against worked examples."""

from pyspark.sql import functions as F

from convrecall.functions import text as T


def one(spark, column):
    value = spark.range(1).select(column.alias("x")).first()["x"]
    return list(value) if isinstance(value, list) else value


def test_normal_forms(spark):
    assert one(spark, T.norm_text(F.lit(" a  b\n c "))) == "a b c"
    assert one(spark, T.norm_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.snake_like(F.lit(" Works - At!! now"))) == "works_at_now"
    assert one(spark, T.canon_predicate(F.lit("Reside in"))) == "lives_in"
    assert one(spark, T.canon_predicate(F.lit("based in"))) == "based_in"
    assert one(spark, T.canon_evidence(F.lit("  In Stockholm。.. "))) == "in stockholm"
    assert one(spark, T.squash(F.lit("A-b  C!"))) == "a b c"


def test_tokens(spark):
    assert one(spark, T.keyword_tokens(F.lit("Where does Alice work_at now? été"))) == ["where", "alice", "work_at", "now", "t"]
    assert one(spark, T.graph_tokens(F.lit("works_at OpenAI"))) == ["works", "at", "openai"]
    assert one(spark, T.keyword_tokens(F.lit(None).cast("string"))) == []


def test_questions(spark):
    for text, want in (("what's up", True), ("whatever works", False), ("I know?", True), ("  Who is it", True), ("", False)):
        assert one(spark, T.looks_like_question(F.lit(text))) is want


def test_scores(spark):
    a = F.array(F.lit("a"), F.lit("a"), F.lit("b"))
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, T.jaccard(a, F.array(F.lit("b"), F.lit("c")))) == 1 / 3
    assert one(spark, T.jaccard(none, none)) == 0
    assert one(spark, T.half_life_weight(F.lit(7 * 24 * 3600.0))) == 0.5
    assert one(spark, T.half_life_weight(F.lit(None).cast("double"))) == 1
    v = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, T.cosine(v(1.0, 0.0), v(0.0, 0.0))) == 0
    assert one(spark, T.cosine(v(3.0, 4.0), v(3.0, 4.0))) == 1
    assert one(spark, T.cosine(v(1.0), v(1.0, 2.0))) is None


def test_json_in_replies(spark):
    assert one(spark, T.json_array(F.lit(' [{"a": 1}] '))) == '[{"a": 1}]'
    assert one(spark, T.json_array(F.lit('Sure\n```json\n[1, 2]\n``` and [3]'))) == "[1, 2]"
    assert one(spark, T.json_array(F.lit("see [1, 2] there"))) == "[1, 2]"
    assert one(spark, T.json_array(F.lit("none [broken"))) is None
    assert one(spark, T.json_object(F.lit("x {1} y"))) == "{1}"
    reply = F.lit('{"scores": [{"index": 2, "score": 5}, {"index": 2, "score": 7}, {"index": 9, "score": 1}]}')
    assert one(spark, T.rank_scores(reply, F.lit(3))) == [0.0, 7.0, 0.0]
    assert one(spark, T.rank_scores(F.lit("no"), F.lit(2))) == [0.0, 0.0]
    assert one(spark, T.rank_scores(reply, F.lit(0))) == []


def test_subjects_and_spans(spark):
    name = F.lit("Alice")
    assert one(spark, T.canon_subject(F.lit("me"), name)) == "Alice"
    assert one(spark, T.canon_subject(F.lit("me"), F.lit(None).cast("string"))) == "<USER>"
    assert one(spark, T.canon_subject(F.lit("ALICE"), name)) == "Alice"
    assert one(spark, T.canon_subject(F.lit("Bob"), name)) == "Bob"
    got = one(spark, T.title_spans(F.lit("Where is Liam Chen’s employer, (Nova Labs) based?")))
    assert got == ["Where", "Liam Chen", "Nova Labs", "Where", "Liam", "Chen", "Nova", "Labs"]
    assert one(spark, T.answer_from_text(F.lit("My favorite music genre is indie folk. Yes"))) == "indie folk"
