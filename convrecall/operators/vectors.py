"""Vector memory: embedding in batches, exact nearest neighbours, retrieval of current facts, upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from convrecall.operators.keyword import top_k

#: Vectors of a block.
BLOCK = 4096
#: Queries that a task compares with a block at once.
ROWS = 256


def hashing_embedder(dim: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed token counts, of unit length."""

    def embed(texts: pd.Series) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for word in (t or "").lower().split():
                h = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed_batch(df: DataFrame, embed: Callable[[pd.Series], list[list[float]]], text: str = "text", batch: int = 96) -> DataFrame:
    """``df`` with ``embedding``: each distinct text is embedded once, in batches, and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                made = embed(part[text])
                if len(made) != len(part):
                    raise ValueError("the embedder must give a vector for each text")
                yield part.assign(embedding=[[float(x) for x in v] for v in made])

    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    return df.join(distinct.mapInPandas(run, f"`{text}` string, embedding array<float>"), text, "left")


def vector_rows(chunks: DataFrame, embed: Callable[[pd.Series], list[list[float]]]) -> DataFrame:
    """``(id, text, source, created_at, vector, metadata)`` of chunks (chunk_id, text, source, created_at, meta).

    ``metadata`` is ``meta`` with source and created_at, where ``meta`` has none of these; null values are left out.
    """
    own = F.map_from_arrays(F.array(F.lit("source"), F.lit("created_at")), F.array(F.col("source"), F.col("created_at").cast("string")))
    meta = F.coalesce("meta", F.create_map().cast("map<string, string>"))
    every = F.map_filter(F.map_zip_with(own, meta, lambda k, ours, given: F.coalesce(given, ours)), lambda k, v: v.isNotNull())
    rows = chunks.select(F.col("chunk_id").alias("id"), "text", "source", "created_at", every.alias("metadata"))
    return embed_batch(rows, embed).select("id", "text", "source", "created_at", F.col("embedding").alias("vector"), "metadata")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK, within: tuple[str, ...] = ()) -> DataFrame:
    """``(qid, id, rank, score)``: exact neighbours of ``queries`` (qid, v) among ``vectors`` (id, v).

    ``score`` is the cosine, or 1 less the squared distance (``l2sq``). Both sides are dealt into blocks and each pair
    of blocks is one product of matrices, of which only each query's best ``k`` travel on. Zero vectors have cosine 0;
    null vectors take no part; what is not a number ranks first, as Spark has it. With ``within``, columns of both
    sides, a query meets the vectors that are equal in them, and the rows have them too.
    """
    types = lambda df, names: [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
    kinds = ", ".join([*types(queries, ["qid", *within]), *types(vectors, ["id"]), "score double"])
    k = max(1, k)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.where("v is not null").groupBy(*within).agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias(name))

    sizes = counted(queries, "q_n").join(counted(vectors, "x_n"), [*within] or None)

    def blocks(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """The rows with the number of their block, once for each block of the other side."""
        rows = df.where("v is not null").select(key, "v", *within)
        rows = rows.join(sizes, [*within]) if within else rows.join(F.broadcast(sizes), F.lit(True))
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_n")).cast("int").alias(f"{own}_block")
        named = [F.col(c).alias(c) for c in (key, "v", *within)]  # the two sides may be of one table: these are columns anew
        return rows.select(*named, mine, F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1)).alias(f"{other}_block"))

    def near(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all pairs that may be among a query's best, and their scores."""
        with np.errstate(invalid="ignore"):
            scores = q @ x.T if metric == "cosine" else 1 - ((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T)
        ranked = np.where(np.isnan(scores), np.inf, scores)
        floor = np.partition(ranked, len(x) - k, axis=1)[:, len(x) - k] - 1e-8 if len(x) > k else np.full(len(q), -np.inf)
        i, j = np.nonzero(ranked >= floor[:, None])
        return i, j, scores[i, j]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(left) and len(right):
            q, x = (np.array(d["v"].tolist(), dtype=np.float64) for d in (left, right))
            if metric == "cosine":
                with np.errstate(invalid="ignore"):
                    q, x = (z / np.where((n := np.linalg.norm(z, axis=1, keepdims=True)) == 0, 1, n) for z in (q, x))
            for at in range(0, len(q), ROWS):
                i, j, score = near(q[at : at + ROWS], x)
                out = pd.DataFrame({"qid": left["qid"].to_numpy()[at + i], "id": right["id"].to_numpy()[j], "score": score})
                out = out.assign(r=out["score"].round(9).fillna(np.inf)).sort_values(["qid", "r", "id"], ascending=[True, False, True])
                made.append(out.groupby("qid", sort=False).head(k))
        if not made:
            return pd.DataFrame({c: [] for c in ("qid", *within, "id", "score")})
        return pd.concat(made).assign(**dict(zip(within, key)))[["qid", *within, "id", "score"]]

    pair = [*within, "q_block", "x_block"]
    q, x = blocks(queries, "qid", "q", "x"), blocks(vectors, "id", "x", "q")
    found = q.groupBy(*pair).cogroup(x.groupBy(*pair)).applyInPandas(run, kinds)
    found = found.fillna(float("nan"), "score")  # pandas has no null beside it
    return top_k(found, k, "id").select("qid", *within, "id", "rank", "score")


def _near_in_conversation(queries: DataFrame, live: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(qid, conv_id, fact_id, score)``: the best of each query among the facts of its conversation, for vectors of any kind.

    Vectors of one length are compared in blocks. Others have no cosine: their facts come last, the smaller ids first.
    """
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull())
    kind = F.when(whole, F.size("v")).otherwise(-1).alias("kind")
    asked = queries.select("qid", "conv_id", "v", kind)
    pool = live.select("conv_id", "fact_id").distinct().join(vectors, "fact_id").select("conv_id", F.col("fact_id").alias("id"), "v", kind)
    found = knn(asked.where("kind >= 0"), pool.where("kind >= 0"), k, within=("conv_id", "kind"))
    order = Window.partitionBy("conv_id", "kind").orderBy("id")
    few = pool.select("conv_id", "id", "kind").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(1, k))
    others = asked.select("qid", "conv_id", F.col("kind").alias("own")).join(few, "conv_id").where("kind <> own or own = -1")
    every = found.select("qid", "conv_id", "id", "score").unionByName(others.select("qid", "conv_id", "id", F.lit(None).cast("double").alias("score")))
    return every.withColumnRenamed("id", "fact_id")


def vector_retrieve(queries: DataFrame, states: DataFrame, vectors: DataFrame, k: int = 5, mode: str = "prefilter", restrict: bool = True) -> DataFrame:
    """``(qid, rank, fact_id, subject, predicate, object, text, score)`` of each query's nearest active facts.

    ``queries`` has qid, conv_id and v; ``vectors`` fact_id and v. ``prefilter`` searches what may be answered;
    ``postfilter`` takes max(10, 5 k) of the whole index first, so that it may find fewer. With ``restrict`` only facts
    of the query's conversation answer: in the first mode a conversation's blocks meet its own queries alone.
    """
    live = states.where("active")
    if mode == "prefilter" and restrict:
        found = _near_in_conversation(queries, live, vectors, k).join(live, ["conv_id", "fact_id"])
    else:
        pool = vectors.join(live.select("fact_id"), "fact_id", "left_semi") if mode == "prefilter" else vectors
        wide = knn(queries.select("qid", "v"), pool.select(F.col("fact_id").alias("id"), "v"), max(10, 5 * k) if mode == "postfilter" else k)
        found = wide.withColumnRenamed("id", "fact_id").drop("rank").join(live, "fact_id")
        if restrict:
            found = found.join(queries.select("qid", "conv_id"), ["qid", "conv_id"], "left_semi")
    best = top_k(found, k, "fact_id")
    return best.select("qid", "rank", "fact_id", "subject", "predicate", "object", F.col("evidence").alias("text"), F.round("score", 6).alias("score"))


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``new``, and of ``new`` the last by ``order`` for each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    fresh = new.withColumn("again", F.row_number().over(last)).where("again = 1").drop("again")
    return existing.join(fresh, key, "left_anti").unionByName(fresh)
