"""Reading conversations in the forms they come in, and writing results and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from convrecall.functions import text as T
from convrecall.operators.curate import SCHEMA
from convrecall.sources.concatenated import read_objects

TURN_SCHEMA = "conv_id string, turn_id int, role string, content string"


def read_conversations(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Conversations of a file or folder, by the declared schema.

    ``lines``: an object, or an array on one line, in each line. ``array``: a pretty-printed array in each file.
    ``concatenated``: objects without separators; a file is read by many tasks. Rows that cannot be parsed are null
    throughout but for ``corrupt``, which holds them.
    """
    schema = f"{SCHEMA}, id string, corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    if form == "concatenated":
        return read_objects(spark, path).select(F.from_json("value", schema, options).alias("x")).select("x.*")
    if form not in ("lines", "array"):
        raise ValueError("form must be lines, array or concatenated")
    return spark.read.schema(schema).options(**options, multiLine=form == "array").json(path)


def _conversation(conversations: DataFrame) -> Column:
    made = F.concat(F.lit("conv_"), F.substring(F.sha2(F.to_json("turns"), 256), 1, 12))
    return F.coalesce("conversation_id", *(["id"] if "id" in conversations.columns else []), made)


def explode_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn_id, role, text)``, turns from 1; missing roles and contents are empty.

    The id is ``conversation_id``, else ``id``, else a hash of the conversation's turns.
    """
    rows = conversations.select(_conversation(conversations).alias("conv_id"), F.posexplode("turns").alias("pos", "t"))
    none = F.lit("")
    return rows.select("conv_id", (F.col("pos") + 1).alias("turn_id"), F.coalesce("t.role", none).alias("role"), F.coalesce("t.content", none).alias("text"))


def explode_probes(conversations: DataFrame) -> DataFrame:
    """``(qid, conv_id, q_idx, question, expected, relevant_texts, scenario, difficulty)``; blank questions leave gaps.

    The id is that of ``explode_turns``.
    """
    rows = conversations.select(_conversation(conversations).alias("conv_id"), "scenario", "difficulty", F.posexplode("eval").alias("pos", "e"))
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = rows.select(
        F.concat_ws("::", "conv_id", (F.col("pos") + 1).cast("string")).alias("qid"), "conv_id", (F.col("pos") + 1).alias("q_idx"),
        bare("e.question").alias("question"), bare("e.expected_answer").alias("expected"),
        F.coalesce("e.relevant_texts", F.expr("cast(array() as array<string>)")).alias("relevant_texts"), "scenario", "difficulty",
    )
    return rows.where("question <> ''")


def write_results(per_query: DataFrame, macro: DataFrame, diagnostics: DataFrame, path: str, form: str = "json") -> None:
    """The three tables of an evaluation, each parted by system."""
    for name, df in (("per_query", per_query), ("macro", macro), ("diagnostics", diagnostics)):
        df.write.mode("overwrite").partitionBy("system").format(form).save(f"{path}/{name}")


def write_dataset(examples: DataFrame, path: str, append: bool = False) -> None:
    """Examples or prompt logs as JSON lines."""
    examples.write.mode("append" if append else "overwrite").json(path)


def facts_to_json(facts: DataFrame) -> DataFrame:
    """Rows as JSON text, in ``json``."""
    return facts.select(F.to_json(F.struct("*")).alias("json"))


def facts_from_json(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows again."""
    return rows.select(F.from_json("json", schema).alias("x")).select("x.*")


def reset(df: DataFrame, path: str) -> None:
    """Empty the table at ``path``, keeping its schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def read_turn_stream(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Insert requests (conv_id, turn_id, role, content) as a stream of files, as turns with normal text."""
    rows = spark.readStream.schema(TURN_SCHEMA).format(form).load(path)
    return rows.select("conv_id", "turn_id", "role", T.norm_text("content").alias("text"))
