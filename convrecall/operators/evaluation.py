"""Scoring retrieval runs: relevance, exact match and ranking metrics, for all queries and systems at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convrecall.functions import text as T


def build_run(results: DataFrame, k: int) -> DataFrame:
    """The first max(k, 1) rows of each query with a ``doc_id``: their id, else a hash of their content and place.

    Of rows with one doc_id the later one stays.
    """
    first = results.where(F.col("rank") <= max(k, 1))
    made = F.concat(T.stable_id("type", "subject", "predicate", "object", "text"), F.lit("_"), (F.col("rank") - 1).cast("string"))
    named = first.withColumn("doc_id", F.when(F.coalesce(F.col("id"), F.lit("")) != "", F.col("id")).otherwise(made))
    last = Window.partitionBy("qid", "doc_id").orderBy(F.desc("rank"))
    return named.withColumn("again", F.row_number().over(last)).where("again = 1").drop("again")


def relevant(expected: Column, texts: Column, text: Column, obj: Column) -> Column:
    """1 where the expected answer is in the text or object, or a relevant text is in the text; else 0."""
    want, has, fact = T.norm_answer(expected), T.norm_answer(text), T.norm_answer(obj)
    quoted = F.exists(F.coalesce(texts, F.expr("cast(array() as array<string>)")), lambda x: (T.norm_answer(x) != "") & F.contains(has, T.norm_answer(x)))
    return F.when(((want != "") & (F.contains(has, want) | F.contains(fact, want))) | quoted, 1).otherwise(0)


def judge(run: DataFrame, probes: DataFrame) -> DataFrame:
    """``run`` with ``rel`` by ``probes`` (qid, expected, relevant_texts)."""
    asked = probes.select("qid", "expected", "relevant_texts")
    return run.join(asked, "qid").withColumn("rel", relevant(F.col("expected"), F.col("relevant_texts"), F.col("text"), F.col("object"))).drop(
        "expected", "relevant_texts"
    )


def _top() -> Column:
    """What a row answers: its object if it is a fact, else its text."""
    return F.when(F.col("type") == "fact", F.col("object")).otherwise(F.col("text"))


def predictions(run: DataFrame, probes: DataFrame) -> DataFrame:
    """``(qid, pred, em)``: the first row's object if it is a fact, else its text; no rows predict the empty string."""
    first = run.where("rank = 1").select("qid", _top().alias("top"))
    pred = T.norm_answer("top")
    return probes.join(first, "qid", "left").select("qid", pred.alias("pred"), (pred == T.norm_answer("expected")).cast("int").alias("em"))


def ranking_metrics(judged: DataFrame, probes: DataFrame, k: int, total: DataFrame | None = None, **also: Column) -> DataFrame:
    """Per query: hits, precision, recall, f1 at k, average precision, reciprocal rank, ndcg, hit and first relevant rank.

    Relevant documents are those retrieved, or ``total`` (qid, n_rel) if given: those of the whole scope. Queries
    without results score 0. ``also`` has further aggregates over a query's rows, null without results.
    """
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = judged.withColumn("found", F.sum("rel").over(upto)).where(F.col("rank") <= k)
    sums = rows.groupBy("qid").agg(
        F.sum("rel").alias("hits"), F.sum(F.col("rel") * F.col("found") / F.col("rank")).alias("ap"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("rank"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count("*").alias("retrieved"), *[c.alias(name) for name, c in also.items()],
    )
    if total is not None:
        sums = sums.join(total.select("qid", "n_rel"), "qid", "left")
    every = probes.select("qid").join(sums, "qid", "left")
    hits = F.coalesce("hits", F.lit(0))
    n_rel = F.coalesce("n_rel", F.lit(0)) if total is not None else hits
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n_rel, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p, r = hits / k, F.when(n_rel > 0, hits / n_rel).otherwise(0.0)
    return every.select(
        "qid", hits.alias("hits"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.when(n_rel > 0, F.coalesce("ap", F.lit(0.0)) / n_rel).otherwise(0.0).alias("ap"),
        F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"), F.when(n_rel > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        F.col("rank").isNotNull().cast("int").alias("hit"), "rank", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), *also,
    )


def evaluate(results: DataFrame, probes: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """One row for each probe: its labels, prediction, exact match and ranking metrics.

    ``total`` (qid, n_rel) has the relevant documents of whole scopes, as ``qrels.totals`` gives them; without it
    those retrieved are all there are, and recall is 1 after any hit.
    """
    run = judge(build_run(results, k), probes)
    scored = ranking_metrics(run, probes, k, total, top__e=F.max(F.when(F.col("rank") == 1, _top())))  # the results are computed once
    rows = probes.join(scored, "qid").withColumn("pred", T.norm_answer("top__e")).withColumn("em", (F.col("pred") == T.norm_answer("expected")).cast("int"))
    return rows.drop("top__e")


MEANS = {"em": "em", "precision": "precision", "recall": "recall", "hits": "hits", "f1": "f1", "ap": "map", "rr": "mrr", "ndcg": "ndcg", "retrieved": "avg_retrieved"}


def macro(per_query: DataFrame, *keys: str) -> DataFrame:
    """Means over the queries of each group of ``keys``; without keys one row, zeros when there are no queries."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in MEANS.items()]
    return per_query.groupBy(*keys).agg(F.count("*").alias("count"), *means)


def breakdown(per_query: DataFrame, *keys: str) -> DataFrame:
    """The same for every prefix of ``keys``, by rollup."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in MEANS.items()]
    return per_query.rollup(*keys).agg(F.count("*").alias("count"), *means)


def quick_checks(tops: DataFrame) -> DataFrame:
    """Flags of the first rows (text, object, expected): answer contained, object equal, squashed texts equal."""
    want = T.norm_answer("expected")
    return tops.withColumns({
        "contained": F.contains(F.lower(F.coalesce("text", F.lit(""))), want),
        "object_equal": T.norm_answer("object") == want,
        "squashed_equal": T.squash(F.coalesce("object", "text")) == T.squash("expected"),
    })
