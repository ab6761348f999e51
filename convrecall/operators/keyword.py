"""Keyword memory: a BM25 index with statistics of its own for each scope, and batched retrieval.

A scope is a conversation or, for one shared corpus, a constant. Every step is a grouping or an equality join on
(scope, term); a query's terms are cut to those asked for before the postings are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from convrecall.functions import text as T
from convrecall.operators.bounded import Blocks, bounded_score, gain, small
from convrecall.sources.shared import stored


def user_turns(turns: DataFrame, index_questions: bool = False) -> DataFrame:
    """Turns of users whose normal text is not empty, with ``text`` normalised; questions only on demand."""
    rows = turns.where(F.lower("role") == "user").withColumn("text", T.norm_text("text")).where("text <> ''")
    return rows if index_questions else rows.where(~T.looks_like_question("text"))


def dedup_turns(turns: DataFrame) -> DataFrame:
    """The first of equal texts in each conversation, by turn_id. Grouped by a hash of the text, with the text verified."""
    first = turns.groupBy("conv_id", F.xxhash64("text").alias("h"), "text").agg(F.min("turn_id").alias("turn_id"))
    return turns.join(first.select("conv_id", "turn_id", F.col("h")), ["conv_id", "turn_id"], "left_semi")


@dataclass(frozen=True)
class Index:
    """``docs`` (scope, doc, length), ``postings`` (scope, term, doc, tf, maybe length), ``terms`` (scope, term, df), ``stats`` (scope, n, avgdl).

    ``blocks`` hold the same postings in blocks with bounds, if they were made.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: Blocks | None = None


def bm25_index(docs: DataFrame, stopwords: tuple[str, ...] = T.STOPWORDS, only: DataFrame | None = None) -> Index:
    """Index ``(scope, doc, text)``. Texts of stopwords alone count as documents of length 0.

    With ``only`` (scope, term) there are postings of these terms alone, so that others are never shuffled.
    """
    tokens = docs.select("scope", "doc", T.keyword_tokens("text", stopwords).alias("tokens"))
    return _index_of(tokens.withColumn("length", F.size("tokens")), only)


def _index_of(tokens: DataFrame, only: DataFrame | None) -> Index:
    """The index of ``(scope, doc, tokens, length)``."""
    each = tokens.select("scope", "doc", F.explode("tokens").alias("term"))
    if only is not None:
        each = each.join(small(only, only.count()), ["scope", "term"], "left_semi")
    postings = each.groupBy("scope", "doc", "term").agg(F.count("*").alias("tf"))
    if only is not None:
        postings = stored(postings)  # of what is asked alone; it is counted, and scored
    lengths = tokens.select("scope", "doc", "length")
    terms = postings.groupBy("scope", "term").agg(F.count("*").alias("df"))
    stats = lengths.groupBy("scope").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    return Index(lengths, postings, terms, stats)


def _asked(queries: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    terms = queries.select("qid", "scope", F.explode(T.keyword_tokens("query", stopwords)).alias("term"))
    return terms.groupBy("qid", "scope", "term").agg(F.count("*").alias("qtf"))


def bm25_score(queries: DataFrame, index: Index, k1: float = 1.5, b: float = 0.75, stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """``(qid, scope, doc, score)`` of ``queries`` (qid, scope, query); a query's repeated terms count each time."""
    parts = weighted_terms(queries, index, stopwords)
    worth = F.col("qtf") * F.col("idf") * gain(F.col("tf"), F.col("length"), k1, b)
    if "length" in index.postings.columns:  # whole documents in one task: where few terms are asked, scores are summed there
        parts = stored(parts)
        found = index.postings.join(small(parts, parts.count()), ["scope", "term"])
        return found.groupBy("qid", "scope", "doc").agg(F.sum(worth).alias("score"))
    postings = index.postings.join(parts.select("scope", "term").distinct(), ["scope", "term"], "left_semi")
    found = parts.join(postings, ["scope", "term"]).join(index.docs, ["scope", "doc"])
    return found.groupBy("qid", "scope", "doc").agg(F.sum(worth).alias("score"))


def weighted_terms(queries: DataFrame, index: Index, stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """``(qid, scope, term, qtf, idf, avgdl)`` of the queries' terms that the index holds."""
    asked = _asked(queries, stopwords)
    wanted = asked.select("scope", "term").distinct()
    weights = (
        index.terms.join(wanted, ["scope", "term"], "left_semi").join(index.stats, "scope")
        .select("scope", "term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"),
                F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    )
    return asked.join(weights, ["scope", "term"]).select("qid", "scope", "term", "qtf", "idf", "avgdl")


def top_k(scored: DataFrame, k: int, *ties: str, by: str = "qid", score: str = "score") -> DataFrame:
    """The best max(1, k) rows of each query with ``rank``; scores are compared to nine places, then ``ties`` ascending."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


def bm25_retrieve(queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, index: Index | None = None) -> DataFrame:
    """``(qid, scope, rank, doc, text, score, bm25)``: each query's best documents, itself excluded.

    With ``index`` (one that is kept, say) nothing is indexed here; ``docs`` then give the texts alone. If it has blocks,
    those that cannot hold one of a query's best are not read; rows are the same.

    A document equal to the normalised query still counts in the statistics. ``score`` is rounded to four places.
    Ties go to the smaller doc, which is the earlier turn.
    """
    # texts are compared by 128 bits of hashes and fetched for what is found; no step before that carries them
    hashes = lambda c: [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]
    kept = index is not None
    if index is None:  # one pass over the texts: what follows reads columns of its table
        docs = stored(docs.select("scope", "doc", "text", *hashes("text"), T.keyword_tokens("text").alias("tokens")).withColumn("length", F.size("tokens")))
        index = _index_of(docs, _asked(queries, T.STOPWORDS).select("scope", "term").distinct())
    else:
        docs = docs.select("scope", "doc", "text", *hashes("text"))
    asked = queries.select("qid", "scope", T.norm_text("query").alias("asked"))
    own = asked.select("qid", "scope", *hashes("asked")).join(docs.select("scope", "doc", "h1", "h2"), ["scope", "h1", "h2"]).select("qid", "scope", "doc")
    if index.blocks is not None:
        parts, skip = stored(weighted_terms(queries, index)), stored(own)
        scored = bounded_score(parts, index.blocks, k, k1, b, skip, stored).where("score > 0")
    else:
        scored, skip = bm25_score(queries, index, k1, b).where("score > 0"), stored(own) if kept else own
    skip = small(skip, skip.count()) if kept else skip
    scored = scored.join(asked.where("asked <> ''").select("qid"), "qid", "left_semi").join(skip, ["qid", "scope", "doc"], "left_anti")
    found = small(top_k(scored, k, "doc"), queries.count() * max(1, k)).join(docs.select("scope", "doc", "text"), ["scope", "doc"])
    return found.select("qid", "scope", "rank", "doc", "text", F.round("score", 4).alias("score"), F.col("score").alias("bm25"))
