"""Fact graphs: nodes and edges of every conversation, seeds of queries, k-hop retrieval with a blended score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from convrecall.functions import text as T
from convrecall.operators.keyword import top_k
from convrecall.sources.shared import stored


def build_graph(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, node) of all facts and edges of the active ones; nodes of superseded facts stay."""
    nodes = states.select("conv_id", F.explode(F.array("subject", "object")).alias("node")).distinct()
    edges = states.where("active").withColumnsRenamed({"subject": "src", "object": "dst"})
    return nodes, edges


def seeds_from_query(queries: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None, limit: int = 32, overlap: float = 0.6) -> DataFrame:
    """``(qid, conv_id, seed, place)``: alias, capitalised spans, nodes whose tokens the query covers, and its fact.

    ``queries`` has qid, conv_id, query and, optionally, q_subject and q_object. Spellings that differ in case are one
    seed, the first. Nodes are found by an equality join on tokens.
    """
    base = queries.select("qid", "conv_id", "query")
    parts = [base.select("qid", "conv_id", F.posexplode(T.title_spans("query")).alias("pos", "seed")).withColumn("kind", F.lit(1))]
    if aliases is not None:
        parts.append(base.join(aliases, "conv_id").select("qid", "conv_id", F.lit(0).alias("pos"), F.col("alias").alias("seed"), F.lit(0).alias("kind")))
    words = base.select("qid", "conv_id", F.explode(F.array_distinct(T.graph_tokens(F.concat_ws(" ", T.clean_tokens("query"))))).alias("token"))
    held = nodes.select("conv_id", "node", F.array_distinct(T.graph_tokens("node")).alias("tokens")).where("size(tokens) > 0")
    held = held.select("conv_id", "node", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    covered = words.join(held, ["conv_id", "token"]).groupBy("qid", "conv_id", "node").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    covered = covered.where(F.col("n") / F.col("size") >= overlap)
    parts.append(covered.select("qid", "conv_id", F.lit(0).alias("pos"), F.col("node").alias("seed"), F.lit(2).alias("kind")))
    for kind, c in ((3, "q_subject"), (4, "q_object")):
        if c in queries.columns:
            parts.append(queries.where(F.col(c) != "").select("qid", "conv_id", F.lit(0).alias("pos"), F.col(c).alias("seed"), F.lit(kind).alias("kind")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = Window.partitionBy("qid", F.lower("seed")).orderBy("kind", "pos", "seed")
    rows = rows.withColumn("again", F.row_number().over(first)).where("again = 1")
    order = Window.partitionBy("qid").orderBy("kind", "pos", "seed")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("qid", "conv_id", "seed", "place")


def parse_query_fact(queries: DataFrame, replies: DataFrame) -> DataFrame:
    """``queries`` with q_subject, q_predicate and q_object: the first item of each query's reply (qid, reply), empty where it has none.

    The reply is a JSON array, by itself, fenced or within other text; texts become normal and the predicate snake case.
    """
    item = F.get(F.from_json(T.json_array("reply"), "array<struct<subject: string, predicate: string, object: string>>"), F.lit(0))
    said = replies.select("qid", item.alias("x")).where("x is not null").dropDuplicates(["qid"])
    own = {"q_subject": T.norm_text("x.subject"), "q_predicate": T.snake_like("x.predicate"), "q_object": T.norm_text("x.object")}
    return queries.join(said, "qid", "left").withColumns(own).drop("x")


def khop_frontier(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``(qid, conv_id, node, hop)``: nodes within ``hops`` undirected steps of the seeds that are nodes, by least steps."""
    reached = seeds.join(nodes.withColumnRenamed("node", "seed"), ["conv_id", "seed"], "left_semi").select(
        "qid", "conv_id", F.col("seed").alias("node"), F.lit(0).alias("hop")
    )
    both = edges.select("conv_id", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(
        edges.select("conv_id", F.col("dst").alias("node"), F.col("src").alias("next"))
    ).distinct()
    reached = reached.distinct()
    for step in range(1, hops + 1):
        out = reached.where(F.col("hop") == step - 1).join(both, ["conv_id", "node"]).select(
            "qid", "conv_id", F.col("next").alias("node"), F.lit(step).alias("hop")
        )
        reached = reached.unionByName(out).groupBy("qid", "conv_id", "node").agg(F.min("hop").alias("hop"))
    return reached


def visits(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, most: int = 512) -> DataFrame:
    """``(qid, conv_id, fact_id, hop)``: the first ``most`` edge visits of each query, in a stated order.

    Each seed that is a node is walked from by itself, in order of place; its nodes come by steps and then by name; a
    node's edges are visited outgoing first, then incoming, each by (turn_id, fact_idx, fact_id). An edge that is met
    again counts again. A hub gives a query no more than its budget: of a node's edges the first ``most`` are kept, of
    its neighbours the first 2 ``most`` by name, of a seed's nodes the first ``most``. Nothing beyond can be visited, as
    every node that is reached has a visit of its own.
    """
    order = ["turn_id", "fact_idx", "fact_id"]
    both = edges.select("conv_id", F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(0).alias("way"), *order).unionByName(
        edges.select("conv_id", F.col("dst").alias("node"), F.col("src").alias("next"), F.lit(1).alias("way"), *order)
    )
    first = lambda df, n, name, by, *o: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*o))).where(F.col(name) <= n)
    near = first(both.select("conv_id", "node", "next").where("node <> next").distinct(), 2 * most, "nth", ["conv_id", "node"], "next").drop("nth")
    reached = seeds.join(nodes.withColumnRenamed("node", "seed"), ["conv_id", "seed"], "left_semi")
    reached = reached.select("qid", "conv_id", "place", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    for step in range(1, hops + 1):
        out = reached.where(F.col("hop") == step - 1).join(near, ["conv_id", "node"]).select("qid", "conv_id", "place", F.col("next").alias("node"), F.lit(step).alias("hop"))
        reached = reached.unionByName(out).groupBy("qid", "conv_id", "place", "node").agg(F.min("hop").alias("hop"))
        reached = stored(first(reached, most, "nth", ["qid", "place"], "hop", "node").drop("nth"))
    each = stored(first(both, most, "nth", ["conv_id", "node"], "way", *order).select("conv_id", "node", "fact_id", "nth"))
    held = reached.join(each.groupBy("conv_id", "node").agg(F.max("nth").alias("n")), ["conv_id", "node"])
    before = Window.partitionBy("qid").orderBy("place", "hop", "node").rowsBetween(Window.unboundedPreceding, -1)  # ``most`` for each seed
    walk = held.withColumn("begun", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("begun") < most)
    return walk.join(each, ["conv_id", "node"]).where(F.col("nth") <= most - F.col("begun")).select("qid", "conv_id", "fact_id", "hop")


def _guided(c: Column, own: str, weight: float) -> Column:
    """``weight`` where the query fact's part resembles the fact's."""
    near = T.jaccard(T.graph_tokens(c), T.graph_tokens(own)) >= 0.5
    return F.when(F.coalesce(c, F.lit("")) != "", F.when(near, weight).otherwise(0.0)).otherwise(0.0)


def graph_retrieve(
    queries: DataFrame, states: DataFrame, k: int = 5, hops: int = 2, aliases: DataFrame | None = None, max_edges: int | None = None,
    half_life_s: float | None = None, max_visits: int | None = None,
) -> DataFrame:
    """``(qid, rank, fact_id, subject, predicate, object, text, hop, path, score)`` of each query's best facts.

    Candidates touch a node that the seeds reach. The path score falls with the distance, so the least distance over
    both ends and all seeds decides. ``max_edges`` bounds a query's candidates in the order (hop, turn_id, fact_idx);
    by default nothing is cut. ``max_visits`` bounds the edges that a query visits, see ``visits``. Ties are broken by
    (hop, turn_id, fact_idx, fact_id). Recency counts 0.20 for every fact; with
    ``half_life_s`` it is halved with each half-life of ``age_s``, a column of ``states`` (null: no age).
    """
    nodes, edges = (stored(x) for x in build_graph(states))
    edges = edges.dropDuplicates(["conv_id", "fact_id"])
    seeds = stored(seeds_from_query(queries, nodes, aliases))
    if max_visits is not None:
        ends = visits(seeds, nodes, edges, hops, max_visits)
    else:
        near = stored(khop_frontier(seeds, nodes, edges, hops))
        touched = edges.select("conv_id", "fact_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
        ends = near.join(touched, ["conv_id", "node"])
    fact = ["turn_id", "fact_idx", "src", "predicate", "dst", "confidence", "evidence"] + ["age_s"] * (half_life_s is not None)
    found = ends.groupBy("qid", "conv_id", "fact_id").agg(F.min("hop").alias("hop")).join(edges.select("conv_id", "fact_id", *fact), ["conv_id", "fact_id"])
    if max_edges is not None:
        order = Window.partitionBy("qid").orderBy("hop", "turn_id", "fact_idx", "fact_id")
        found = found.withColumn("visit", F.row_number().over(order)).where(F.col("visit") <= max_edges).drop("visit")
    of_seeds = seeds.groupBy("qid").agg(F.collect_set(F.lower("seed")).alias("seeds"))  # 32 a query at most
    hints = ["q_subject", "q_predicate", "q_object"]
    asked = queries.select("qid", "query", *[F.col(c) if c in queries.columns else F.lit("").alias(c) for c in hints])
    rows = found.join(asked, "qid").join(of_seeds, "qid")
    words = T.graph_tokens("query")
    guided = _guided(F.col("q_subject"), "src", 0.1) + _guided(F.col("q_object"), "dst", 0.1) + _guided(F.col("q_predicate"), "predicate", 0.1)
    path = (0.55 * T.jaccard(words, T.graph_tokens("predicate")) + 0.45 * F.col("confidence")) / (1 + 0.3 * F.col("hop")) + guided
    lexical = T.jaccard(words, T.graph_tokens(F.concat_ws(" ", "src", "predicate", "dst")))
    touches = F.array_contains("seeds", F.lower("src")) | F.array_contains("seeds", F.lower("dst"))
    boost = _guided(F.col("q_predicate"), "predicate", 0.05) + _guided(F.col("q_object"), "dst", 0.05)
    rows = rows.withColumn("path", path).where("path > 0")
    recency = F.lit(0.20) if half_life_s is None else 0.20 * T.half_life_weight(F.col("age_s"), half_life_s)
    rows = rows.withColumn("score", 0.45 * F.col("path") + 0.30 * lexical + recency + F.when(touches, 0.05).otherwise(0.0) + boost)
    best = top_k(rows, k, "hop", "turn_id", "fact_idx", "fact_id")
    return best.select(
        "qid", "rank", "fact_id", F.col("src").alias("subject"), "predicate", F.col("dst").alias("object"), F.col("evidence").alias("text"), "hop", "path", "score"
    )
