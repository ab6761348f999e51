"""BM25 over postings that lie in blocks with bounds, so that a query reads only blocks that can hold one of its best.

A block is some hundred documents of one scope and of about one length. For each term it has the highest frequency and
the least length, from which an upper bound of any score in the block follows for whatever ``k1``, ``b``, average length
and document frequencies hold when a query comes. So bounds stay right while documents come and go: what has changed
since the blocks were made is left out of them and scored beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Documents of a block, about.
BLOCK = 128
#: Scores are compared to nine places, and sums in a cluster have no order.
SLACK = 1e-8


@dataclass(frozen=True)
class Blocks:
    """``lists`` (scope, term, block, most, least, list of doc, tf and length), ``changed`` (scope, doc), ``fresh`` postings.

    Documents in ``changed`` are no longer what ``lists`` has of them; ``fresh`` (scope, term, doc, tf, length) has those of
    them that are there.
    """

    lists: DataFrame
    changed: DataFrame
    fresh: DataFrame


#: Rows that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def dealt_to_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``docs`` (scope, doc, length, maybe more) with ``block``; a block's documents are in one task.

    Documents are dealt by length, in steps of a quarter of a doubling, and within a step by a hash into blocks of
    ``size`` on average; how many there are is counted first.
    """
    step = F.floor(4 * F.log2(F.col("length") + 1.0)).cast("long")
    rows = docs.where("length > 0").withColumn("step", step)
    parts = rows.groupBy("scope", "step").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts"))
    dealt = rows.join(small(parts, parts.count()), ["scope", "step"]).withColumn("block", F.shiftleft("step", 40) + part)
    return dealt.drop("step", "parts").repartition("scope", "block")


def block_lists(postings: DataFrame) -> DataFrame:
    """The lists of ``postings`` (scope, doc, block, length, term, tf). A term that all documents hold is in as many as there are blocks."""
    return postings.groupBy("scope", "term", "block").agg(
        F.max("tf").alias("most"), F.min("length").alias("least"), F.sort_array(F.collect_list(F.struct("doc", "tf", "length"))).alias("list")
    )


def gain(tf: Column, length: Column, k1: float, b: float) -> Column:
    """What a frequency is worth in a document of a length; it grows with the one and falls with the other."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avgdl")))


def upper_bounds(parts: DataFrame, lists: DataFrame, k1: float, b: float) -> DataFrame:
    """``(qid, scope, block, upper)`` of every block that holds a term of a query; lists themselves are not read.

    ``parts`` are the queries' terms (qid, scope, term, qtf, idf, avgdl).
    """
    each = parts.join(lists.select("scope", "term", "block", "most", "least"), ["scope", "term"])
    most = F.sum(F.col("qtf") * F.col("idf") * gain(F.col("most"), F.col("least"), k1, b))
    return each.groupBy("qid", "scope", "block").agg(most.alias("upper"))


def best_blocks(upper: DataFrame, n: int) -> DataFrame:
    """``(qid, scope, block)`` of each query's ``n`` blocks of the highest bounds."""
    order = Window.partitionBy("qid").orderBy(F.desc("upper"), "scope", "block")
    return upper.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("qid", "scope", "block")


def rest_of_blocks(upper: DataFrame, seen: DataFrame, floor: DataFrame) -> DataFrame:
    """``(qid, scope, block)`` that are not in ``seen`` and reach the query's ``floor``; all of them, if it has none."""
    left = upper.join(seen, ["qid", "scope", "block"], "left_anti").join(floor, "qid", "left")
    return left.where(F.col("floor").isNull() | (F.col("upper") * (1 + SLACK) + SLACK >= F.col("floor"))).select("qid", "scope", "block")


def read_blocks(parts: DataFrame, blocks: Blocks, some: DataFrame) -> DataFrame:
    """The postings (and terms) of ``some`` (qid, scope, block) that still hold."""
    return _postings_of(parts, blocks, some).drop("block").join(blocks.changed, ["scope", "doc"], "left_anti")


def _postings_of(parts: DataFrame, blocks: Blocks, some: DataFrame) -> DataFrame:
    """The same, changed documents included, with ``block``: a block is in one task, so its documents' scores are summed there."""
    n = parts.count()
    asked = small(parts.select("scope", "term").distinct(), n)
    lists = blocks.lists.select("scope", "term", "block", "list").join(asked, ["scope", "term"], "left_semi").repartition("scope", "block")
    wanted = some.groupBy("scope", "block").agg(F.collect_set("qid").alias("qids"))
    rows = lists.join(wanted, ["scope", "block"]).join(small(parts, n), ["scope", "term"]).where("array_contains(qids, qid)")
    return rows.select(*parts.columns, "block", F.inline("list"))


def bounded_score(parts: DataFrame, blocks: Blocks, k: int, k1: float, b: float, skip: DataFrame, keep) -> DataFrame:
    """``(qid, scope, doc, score)`` that hold each query's ``k`` best, with scores as those of all postings.

    First come the blocks of the highest bounds and all that changed since; the ``k``-th best score of these is a floor.
    Blocks whose bound is below it cannot hold a better document and are not read. A query that has found fewer than
    ``k`` has no floor and reads all of its blocks. ``skip`` (qid, scope, doc) are no answers; ``keep`` writes a table
    that is used more than once.
    """
    k = max(1, k)

    skip = small(skip, skip.count())
    gone = keep(blocks.changed)
    gone = small(gone, gone.count())

    def scored(postings: DataFrame, *block: str) -> DataFrame:
        worth = F.col("qtf") * F.col("idf") * gain(F.col("tf"), F.col("length"), k1, b)
        rows = postings.groupBy("qid", "scope", "doc", *block).agg(F.sum(worth).alias("score"))
        return rows.drop(*block).join(skip, ["qid", "scope", "doc"], "left_anti")

    def in_blocks(some: DataFrame) -> DataFrame:
        return scored(_postings_of(parts, blocks, some), "block").join(gone, ["scope", "doc"], "left_anti").select("qid", "scope", "doc", "score")

    upper = keep(upper_bounds(parts, blocks.lists, k1, b))
    first = keep(best_blocks(upper, 2 * k))
    changed = parts.join(blocks.fresh, ["scope", "term"]).select(*parts.columns, "doc", "tf", "length")
    found = keep(in_blocks(first).unionByName(scored(changed)))
    order = Window.partitionBy("qid").orderBy(F.desc("score"))
    floor = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("qid", F.col("score").alias("floor"))
    return found.unionByName(in_blocks(rest_of_blocks(upper, first, floor)))
