"""Curation of evaluation datasets: validation with reasons for rejection, alignment, audits, and the generation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convrecall.functions import text as T

# Turns of a conversation by difficulty, and temperatures of generation.
TURNS = {"easy": (4, 6), "moderate": (4, 8), "complex": (8, 10)}
TEMPERATURES = {"easy": 0.6, "moderate": 0.8, "complex": 1.0}
SCENARIOS = ("simple", "update", "multihop")

SCHEMA = (
    "conversation_id string, scenario string, difficulty string, noise_tags array<string>, "
    "turns array<struct<role: string, content: string>>, "
    "eval array<struct<question: string, expected_answer: string, relevant_texts: array<string>, subject_hint: string>>"
)


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def validate(examples: DataFrame) -> DataFrame:
    """Normalised examples with ``reject_reason``, null where the example is good.

    A question that no user turn contains is replaced by the last user turn that ends in a question mark.
    """
    low = lambda c: F.lower(_bare(c))
    no_turns = F.expr("cast(array() as array<struct<role: string, content: string>>)")
    turns = F.transform(F.coalesce("turns", no_turns), lambda t: F.struct(low(t["role"]).alias("role"), _bare(t["content"]).alias("content")))
    no_eval = F.expr("cast(array() as array<struct<question: string, expected_answer: string, relevant_texts: array<string>, subject_hint: string>>)")
    items = F.transform(
        F.coalesce("eval", no_eval),
        lambda e: F.struct(
            low(e["question"]).alias("question"), low(e["expected_answer"]).alias("expected_answer"),
            F.transform(F.coalesce(e["relevant_texts"], F.expr("cast(array() as array<string>)")), T.canon_evidence).alias("relevant_texts"),
            F.nullif(_bare(e["subject_hint"]), F.lit("")).alias("subject_hint"),
        ),
    )
    rows = examples.withColumns({"turns": turns, "eval": items, "scenario": low(F.col("scenario")), "difficulty": low(F.col("difficulty")),
                                 "noise_tags": F.coalesce("noise_tags", F.expr("cast(array() as array<string>)"))})
    users = F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: F.lower(t["content"]))
    rows = rows.withColumn("users", users).withColumn("asked", F.get("eval", F.lit(0))["question"])
    rows = rows.withColumn("found", F.exists("users", lambda u: F.contains(u, F.col("asked"))))
    rows = rows.withColumn("last", F.try_element_at(F.filter("users", lambda u: u.endswith("?")), F.lit(-1)))
    bad_role = F.exists("turns", lambda t: ~t["role"].isin("user", "assistant"))
    reason = (
        F.when(F.coalesce(F.col("conversation_id"), F.lit("")) == "", "no conversation_id").when(bad_role, "invalid role")
        .when(F.size("eval") == 0, "no eval").when(~F.col("found") & F.col("last").isNull(), "question not in user turns")
    )
    aligned = F.transform("eval", lambda e, i: F.when((i == 0) & ~F.col("found") & F.col("last").isNotNull(), e.withField("question", F.col("last"))).otherwise(e))
    return rows.withColumn("reject_reason", reason).withColumn("eval", aligned).drop("users", "asked", "found", "last")


def split_valid(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good examples, and rejected ones with their reasons; together they are all of them."""
    rows = validate(examples)
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def enforce_labels(examples: DataFrame, conversation_id: str, scenario: str, difficulty: str) -> DataFrame:
    """Examples with the labels they were made for, taken from those columns, and their first eval item alone."""
    return examples.withColumns({
        "conversation_id": F.col(conversation_id), "scenario": F.col(scenario), "difficulty": F.col(difficulty), "eval": F.slice("eval", 1, 1),
    })


def audit(examples: DataFrame) -> DataFrame:
    """A flag for each rule of style that good examples should keep, by conversation_id."""
    e = F.get("eval", F.lit(0))
    question, answer, quotes = e["question"], e["expected_answer"], F.coalesce(e["relevant_texts"], F.expr("cast(array() as array<string>)"))
    users = F.filter("turns", lambda t: t["role"] == "user")
    spoken = F.transform("turns", lambda t: F.lower(t["content"]))
    bounds = F.lit(True)
    for d, (lo, hi) in TURNS.items():
        bounds = F.when(F.col("difficulty") == d, F.size("turns").between(lo, hi)).otherwise(bounds)
    return examples.select(
        "conversation_id", "scenario", "difficulty",
        F.coalesce(question == F.lower(F.try_element_at(users, F.lit(-1))["content"]), F.lit(False)).alias("last_turn"),
        F.coalesce(question.rlike(r"^[^?]*\?$"), F.lit(False)).alias("one_mark"),
        F.coalesce(F.length(question) <= 120, F.lit(False)).alias("short_question"),
        F.coalesce(~question.rlike(r" and | or | as well as |[,;:/&]"), F.lit(False)).alias("one_fact"),
        F.coalesce((answer == F.lower(answer)) & ~answer.rlike(r"[.!?,;:]$") & ~answer.rlike(r"\b(is|are|was|were|do|does|did|can|should)\b"), F.lit(False)).alias("plain_answer"),
        (F.size(quotes).between(1, 3) & F.forall(quotes, lambda q: F.length(q).between(5, 140) & (q == F.lower(q)))).alias("fine_quotes"),
        F.forall(quotes, lambda q: F.exists(spoken, lambda s: F.contains(s, q))).alias("quoted"),
        bounds.alias("turn_count"),
    )


def audit_rates(flags: DataFrame) -> DataFrame:
    """The share of examples that keep each rule, by scenario and difficulty."""
    own = [c for c in flags.columns if c not in ("conversation_id", "scenario", "difficulty")]
    return flags.groupBy("scenario", "difficulty").agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in own])


def counts(examples: DataFrame) -> DataFrame:
    """Examples by scenario and difficulty."""
    return examples.groupBy("scenario", "difficulty").agg(F.count("*").alias("n"))


def generation_grid(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """A row for each example to generate: id, labels, a seed of its own and a temperature."""
    table = F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(d).alias("difficulty"), F.lit(t).alias("temperature"))
        for s in SCENARIOS for d, t in TEMPERATURES.items()
    ])
    cells = spark.range(1).select(F.explode(table).alias("x")).select("x.*")
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else cells.withColumn("i", F.lit(0)).limit(0)
    name = F.format_string("%s_%s_%d_%03d", F.upper("scenario"), F.upper("difficulty"), F.lit(seed), "i")
    return rows.select(name.alias("conversation_id"), "scenario", "difficulty", "temperature", F.pmod(F.xxhash64(name), F.lit(1_000_000_000)).alias("row_seed"))


def generation_prompts(grid: DataFrame, system: str, template: str, model: str) -> DataFrame:
    """``grid`` with the two prompts of each example and the model's name, in the form of a prompt log.

    ``template`` names columns of the grid and ``{n_turns}``, the turns asked for, in braces. The texts of the prompts
    are the caller's, as the model is.
    """
    turns = F.create_map(*[x for d, (low, high) in TURNS.items() for x in (F.lit(d), F.lit(f"{low}-{high}"))])
    user = F.lit(template)
    for name, value in (*[(c, F.col(c).cast("string")) for c in grid.columns], ("n_turns", turns[F.col("difficulty")])):
        user = F.replace(user, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return grid.withColumns({"system": F.lit(system), "user": user, "model": F.lit(model)})


def parse_generated(replies: DataFrame) -> DataFrame:
    """Examples from replies (conversation_id, scenario, difficulty, reply), validated; what fails keeps its reason."""
    own = F.from_json(T.json_object("reply"), SCHEMA)
    want = {c: F.col(c).alias(f"want_{c}") for c in ("conversation_id", "scenario", "difficulty")}
    rows = replies.select(*want.values(), own.alias("x")).select(*[f"want_{c}" for c in want], "x.*")
    made = enforce_labels(rows, *[f"want_{c}" for c in want]).drop(*[f"want_{c}" for c in want])
    return validate(made)
