"""The given tables as the library's own: turns, corpora, probes, facts, graphs, nested conversations.

Each DataFrame has its twin in SQL, as a common table expression, so that queries and their SQL start alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from convrecall.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("turn_id"), "role", "text")


TURNS = "turns AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS turn_id, role, text FROM conversations)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one scope."""
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("doc"), T.norm_text("text").alias("text"))


CORPUS = "docs AS (SELECT 'all' AS scope, doc_id AS doc, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM documents)"


def longest_word(text: Column | str) -> Column:
    """The longest run of a-z in the lower-case text, the first of equal ones by name."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    longer = lambda a, b: F.when((F.length(b) > F.length(a)) | ((F.length(b) == F.length(a)) & (b < a)), b).otherwise(a)
    return F.aggregate(words, F.lit(""), longer)


def longest_word_sql(text: str) -> str:
    better = "CASE WHEN length(b) > length(a) OR (length(b) = length(a) AND b < a) THEN b ELSE a END"
    return f"list_reduce(list_prepend('', regexp_extract_all(lower({text}), '[a-z]+')), lambda a, b: {better})"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as probes of the corpus: each should find documents that hold it."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), T.norm_text("text").alias("query"), F.col("item_id").alias("item"))
    return rows.select(
        "qid", F.lit("all").alias("scope"), "query", F.col("query").alias("expected"), F.array("query").alias("relevant_texts"),
        F.when(F.col("item") % 2 == 0, "simple").otherwise("multihop").alias("scenario"), F.when(F.col("item") % 3 == 0, "easy").otherwise("complex").alias("difficulty"),
    )


PASSAGES = (
    "probes AS (SELECT CAST(item_id AS VARCHAR) AS qid, 'all' AS scope, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS query, "
    "CASE WHEN item_id % 2 = 0 THEN 'simple' ELSE 'multihop' END AS scenario, CASE WHEN item_id % 3 = 0 THEN 'easy' ELSE 'complex' END AS difficulty FROM benchmark)"
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: a conversation for each user, a turn for each event; a sign-up gives the user's name."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("turn_id", F.row_number().over(order)).withColumn("k", F.get_json_object("props", "$.k"))
    name = F.col("event_type") == "signup"
    rows = rows.select(
        F.col("user_id").alias("conv_id"), "turn_id", F.lit(0).alias("fact_idx"), F.col("event_id").alias("ingest_seq"), F.lit("<USER>").alias("subject"),
        F.when(name, "name").otherwise(F.col("event_type")).alias("predicate"), F.when(name, F.concat(F.lit("u"), "user_id", F.lit("_"), "k")).otherwise(F.col("k")).alias("object"),
        (F.col("value") / 100).alias("confidence"), F.col("props").alias("evidence"),
    )
    return rows.withColumn("fact_id", T.fact_id("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object"))


FACTS = """facts0 AS (
  SELECT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn_id, 0 AS fact_idx, event_id AS ingest_seq,
    '<USER>' AS subject, CASE event_type WHEN 'signup' THEN 'name' ELSE event_type END AS predicate,
    CASE event_type WHEN 'signup' THEN 'u' || user_id || '_' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS object,
    value / 100 AS confidence, props AS evidence FROM events
), facts AS (
  SELECT *, 'fact_' || substr(sha256(concat_ws(chr(31), conv_id, turn_id, fact_idx, subject, predicate, object)), 1, 12) AS fact_id FROM facts0
)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and nations as active facts of one graph."""
    nation = table(spark, sf_dir, "nation")
    lives = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    based = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def rows(df: DataFrame, key: str, idx: int, s: str, p: str, o: str, c: float) -> DataFrame:
        return df.select(
            F.lit("world").alias("conv_id"), F.col(key).cast("int").alias("turn_id"), F.lit(idx).alias("fact_idx"), F.col(s).alias("subject"),
            F.lit(p).alias("predicate"), F.col(o).alias("object"), F.lit(c).alias("confidence"), F.lit(True).alias("active"),
        )

    every = rows(lives, "c_custkey", 0, "c_name", "lives_in", "n_name", 0.8).unionByName(
        rows(based, "s_suppkey", 1, "s_name", "based_in", "n_name", 0.85)
    ).unionByName(rows(part, "n_nationkey", 2, "n_name", "part_of", "r_name", 0.9))
    return every.withColumn("evidence", T.fact_text("subject", "predicate", "object")).withColumn(
        "fact_id", T.fact_id("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object")
    )


WORLD = """world0 AS (
  SELECT 'world' AS conv_id, CAST(c_custkey AS INTEGER) AS turn_id, 0 AS fact_idx, c_name AS subject, 'lives_in' AS predicate, n_name AS object, 0.8::DOUBLE AS confidence
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'world', CAST(s_suppkey AS INTEGER), 1, s_name, 'based_in', n_name, 0.85 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'world', CAST(n_nationkey AS INTEGER), 2, n_name, 'part_of', r_name, 0.9 FROM nation JOIN region ON n_regionkey = r_regionkey
), world AS (
  SELECT *, concat_ws(' | ', subject, predicate, object) AS evidence,
    'fact_' || substr(sha256(concat_ws(chr(31), conv_id, turn_id, fact_idx, subject, predicate, object)), 1, 12) AS fact_id FROM world0
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each nation."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("qid"), F.lit("world").alias("conv_id"), F.concat(F.lit("Where is "), "n_name", F.lit(" and who lives there?")).alias("query")
    )


QUESTIONS = "questions AS (SELECT n_name AS qid, 'world' AS conv_id, 'Where is ' || n_name || ' and who lives there?' AS query FROM nation)"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dataset rows; the last user turn is the question, the first turn the evidence, its longest word the answer."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )  # conversations of an evaluation set have a few turns
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    asked = F.try_element_at(F.filter("t", lambda x: x["role"] == "user"), F.lit(-1))["text"]
    item = F.struct(
        asked.alias("question"), longest_word(F.element_at("t", 1)["text"]).alias("expected_answer"),
        F.array(F.element_at("t", 1)["text"]).alias("relevant_texts"), F.lit(None).cast("string").alias("subject_hint"),
    )
    return rows.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("conversation_id"), F.when(F.col("conv_id") % 2 == 0, " Simple").otherwise("update").alias("scenario"),
        F.when(F.col("conv_id") % 3 == 0, "EASY").otherwise("complex ").alias("difficulty"), F.lit(None).cast("array<string>").alias("noise_tags"),
        said.alias("turns"), F.when(asked.isNotNull(), F.array(item)).alias("eval"),
    )


_LAST_USER = "arg_max(text, turn) FILTER (WHERE role = 'user')"

NESTED = f"""nested AS (
  SELECT 'conv_' || conv_id AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'simple' ELSE 'update' END AS scenario,
    CASE WHEN conv_id % 3 = 0 THEN 'easy' ELSE 'complex' END AS difficulty, count(*) AS n_turns, bool_or(role NOT IN ('user', 'assistant')) AS bad_role,
    {_LAST_USER} AS question, {longest_word_sql('arg_min(text, turn)')} AS answer, arg_min(text, turn) AS quote
  FROM conversations GROUP BY conv_id
)"""
