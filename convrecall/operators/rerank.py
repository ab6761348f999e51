"""Reranking retrieved rows, by words or by a model's replies, and the envelope that all systems' results share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convrecall.functions import text as T

ENVELOPE = ("type", "id", "text", "subject", "predicate", "object", "source", "created_at")


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(T.norm_text(c)), " "), lambda t: t != "")


def lexical_rerank(rows: DataFrame) -> DataFrame:
    """``rows`` (qid, query, text, score) with ``rerank``: 80 parts the old score, 20 the overlap of words."""
    return rows.withColumn("rerank", 80.0 * F.col("score") + 20.0 * T.jaccard(_words("query"), _words("text")))


def rank_prompts(rows: DataFrame) -> DataFrame:
    """``(qid, n, prompt)``: the query and its candidates listed from 1 in the order of rank, for any model to score."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "text")))
    lines = F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), T.norm_text(x["text"])))
    grouped = rows.groupBy("qid").agg(F.first("query").alias("query"), F.count("*").cast("int").alias("n"), lines.alias("lines"))
    return grouped.select("qid", "n", F.concat(F.lit("Query: "), "query", F.lit("\n"), F.array_join("lines", "\n")).alias("prompt"))


def model_rerank(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """``rows`` with ``rerank`` from replies (qid, n, reply); rows without a score get 0."""
    scores = replies.select("qid", F.posexplode(T.rank_scores("reply", F.col("n"))).alias("at", "rerank"))
    scored = scores.select("qid", (F.col("at") + 1).alias("rank"), "rerank")
    return rows.join(scored, ["qid", "rank"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def envelope(results: DataFrame, system: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Results of one system in the shared form; ``text`` falls back to object, then subject, then the empty string.

    ``scores`` maps the names of ``parts``, the columns that the score was made of, to their values; null ones are left out.
    """
    have = set(results.columns)
    pairs = [x for c in parts for x in (F.lit(c), F.col(c).cast("double"))]
    scores = F.map_filter(F.create_map(*pairs).cast("map<string, double>"), lambda k, v: v.isNotNull()).alias("scores")
    cols = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ENVELOPE]
    rows = results.select(F.lit(system).alias("system"), "qid", "rank", F.col("score").cast("double").alias("score"), *cols, scores)
    filled = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "object", "subject")], F.lit(""))
    return rows.withColumn("text", filled)
