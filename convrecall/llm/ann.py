"""Approximate nearest neighbours by cross-polytope hashing.

Each hash turns unit vectors by its own pseudo-rotation (random signs and a fast Hadamard transform, three times) and
takes the nearest signed axis. A table files vectors under several hashes, as many as bring a bucket to about MEAN
vectors, however many there are. A query looks into the buckets of each table whose axes are nearest by the sum of
their coordinates; what it meets there is ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convrecall.llm.common import checkpoint

TABLES = 16
#: Vectors of a bucket, on average, from which on a further hash (or more axes of it) splits the buckets.
MEAN = 32
#: Buckets of a table that a query looks into, where a table has one hash; they grow with the root ROOT of the buckets.
PROBES = 10
ROOT = 4
#: Vectors that a task ranks at a time; larger buckets are dealt out in blocks, and so are their queries.
BLOCK = 4096
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rows under a hash's pseudo-rotation, filled up with zeros to a power of two."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x = hadamard(x * s)
    return x


def plan(n: int, dim: int, mean: int = MEAN) -> list[int]:
    """Axes of each hash of a table for n vectors: all of them for the first, then as many as buckets should be split by."""
    most = 1 << max(0, (dim - 1).bit_length())
    out, want = [most], n / mean / (2 * most)
    while want >= 2:
        out.append(min(most, 1 << (int(want / 2).bit_length() - 1)))
        want /= 2 * out[-1]
    return out


def probes_of(hashes: list[int], probes: int = PROBES) -> int:
    """Buckets to look into: ever more, but an ever smaller share of all."""
    return round(probes * np.prod([2.0 * a for a in hashes[1:]]) ** (1 / ROOT))


def buckets(x: np.ndarray, table: int, hashes: list[int], probes: int, seed: int = SEED) -> np.ndarray:
    """For each row its ``probes`` nearest buckets of a table, nearest first: the signed axes of all hashes as one number."""
    at, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, axes in enumerate(hashes):
        y = turned(x, table + 1_000_000 * k, seed)[:, :axes]
        both = np.stack([y, -y], 2).reshape(len(y), -1)  # 2 i for axis i, 2 i + 1 for its negative
        score = (score[:, :, None] + both[:, None, :]).reshape(len(x), -1)
        best = score.argmax(1)[:, None] if probes == 1 else np.argsort(-score, axis=1, kind="stable")[:, :probes]
        score = np.take_along_axis(score, best, 1)
        at = np.take_along_axis(at, best // (2 * axes), 1) * 2 * axes + best % (2 * axes)
    return at


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; brought to a common size first, as squares of large components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows with an id and a vector that is not zero and has no null, NaN or infinite component.

    Floats stay floats; vectors of any other numbers are taken as doubles. Where several rows share an id, one of them
    stays (that of the least vector).
    """
    v = F.col(vector)
    fine = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    kind = vectors.schema[vector].dataType.simpleString()
    own = vectors.where(F.col(id_).isNotNull() & fine).select(F.col(id_).cast("long").alias("id"), (v if kind == "array<float>" else v.cast("array<double>")).alias("w"))
    return own.groupBy("id").agg(F.min("w").alias("v"))


def lengths(rows: DataFrame) -> dict[int, int]:
    """How many rows have a ``v`` of each length: a number for each length, of which tables have few."""
    return {r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()}


def _hashed(rows: DataFrame, tables: int, hashes: list[int], probes: int, seed: int) -> DataFrame:
    """``(id, bucket)``: the bucket's table, its first axis and the others as one number."""
    size = int(np.prod([2 * a for a in hashes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = unit(matrix(part.column(1)))
                for t in range(tables):
                    found = buckets(x, t, hashes, probes, seed) + t * size
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.repeat(np.arange(len(x)), found.shape[1]))), pa.array(found.ravel())], ["id", "bucket"]
                    )

    return rows.mapInArrow(run, "id long, bucket long")


def search(
    queries: DataFrame, rows: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES, mean: int = MEAN, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query the ``k`` rows of largest inner product that were found.

    Both tables have ``id`` and ``v`` as ``usable`` gives them. A row never answers its own id. A query is answered by
    rows of its own length alone; each length is searched by itself, and a query whose length no row has gets none.
    Scores are in double precision on the vectors as given; ties go to the smaller id. Every row is filed once in each
    table. Buckets of neighbouring numbers are ranked together, in cells of about ``block`` rows, so a query is
    sent once to a cell, with the buckets it looks into. A bucket of more than ``block`` rows, or that more than
    ``block`` queries look into, is dealt out in blocks of both; each meets all, and nothing is cut. Queries that met fewer than ``k`` rows are compared with
    all rows, block by block. Empty tables give none.
    """
    sizes = lengths(rows) or {1: 0}
    alike = lambda df, d: df.where(F.size("v") == d)
    found = [_search(alike(queries, d), alike(rows, d), n, d, k, tables, probes, mean, block, seed) for d, n in sizes.items()]
    return reduce(DataFrame.unionByName, found)


def _search(queries: DataFrame, rows: DataFrame, n: int, dim: int, k: int, tables: int, probes: int, mean: int, block: int, seed: int) -> DataFrame:
    """``search`` among ``n`` rows of one length."""
    hashes = plan(n, dim, mean)
    # buckets of some first axes of a table, and the cells that they are dealt out to where they are too many for one
    mean_axis = max(1, n // (2 * hashes[0]))
    wide = int(np.prod([2 * a for a in hashes[1:]])) * max(1, 1 << ((block // mean_axis).bit_length() - 1) if block > mean_axis else 1)
    cells = -(-mean_axis // block)
    filed = checkpoint(_hashed(rows, tables, hashes, 1, seed))
    asked = checkpoint(_hashed(queries, tables, hashes, probes_of(hashes, probes), seed))
    of = lambda df, c: df.groupBy("bucket").agg(F.count("*").alias(c))
    hot = of(filed, "n").join(of(asked, "m"), "bucket", "full").where((F.col("n") > block) | (F.col("m") > block))
    blocks = lambda c: F.greatest(F.ceil(F.coalesce(F.col(c), F.lit(0)) / block), F.lit(1)).cast("int")
    hot = checkpoint(hot.select("bucket", blocks("n").alias("of_rows"), blocks("m").alias("of_queries")))
    cell = F.struct(F.floor(F.col("bucket") / wide).alias("axis"), F.pmod(F.xxhash64("bucket"), F.lit(cells).cast("long")).alias("part"))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        """(id, axis, part, i, j, buckets): once to each cell; to all blocks of the other side where a bucket is hot."""
        known = df.join(hot, "bucket", "left")
        cold = known.where(f"{own} is null").select("id", cell.alias("c"), "bucket").groupBy("id", "c").agg(F.collect_list("bucket").alias("buckets"))
        cold = cold.select("id", "c.axis", "c.part", F.lit(0).alias("i"), F.lit(0).alias("j"), "buckets")
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        warm = known.where(f"{own} is not null").withColumn("mine", mine).withColumn("theirs", F.explode(F.expr(f"sequence(0, {other} - 1)")))
        i, j = ("mine", "theirs") if own == "of_rows" else ("theirs", "mine")
        warm = warm.select("id", (-1 - F.col("bucket")).alias("axis"), F.lit(0).cast("long").alias("part"), F.col(i).alias("i"), F.col(j).alias("j"), F.array("bucket").alias("buckets"))
        return cold.unionByName(warm)

    there = placed(filed, "of_rows", "of_queries").join(rows, "id")
    here = placed(asked, "of_queries", "of_rows").join(queries, "id")
    best = checkpoint(_best(_ranked(here, there, k), k))
    few = queries.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    parts = -(-n // block) or 1
    all_of = lambda df, part: df.select(
        "id", F.lit(0).cast("long").alias("axis"), part.alias("part"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.array(F.lit(0).cast("long")).alias("buckets"), "v"
    )
    everywhere = all_of(rows, F.pmod(F.xxhash64("id"), F.lit(parts).cast("long")))
    few = all_of(few, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _best(best.drop("rank").unionByName(_ranked(few, everywhere, k)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked(asked: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each cell that it looks into, among the rows of its buckets."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        q, x = (matrix(t.column(-1).combine_chunks()) for t in (left, right))
        q_ids, x_ids = (t.column(-3).to_numpy() for t in (left, right))
        of = lambda t: t.column(-2).combine_chunks()
        home = of(right).flatten().to_numpy()
        order = np.argsort(home, kind="stable")
        names, starts = np.unique(home[order], return_index=True)
        order = np.repeat(np.arange(len(x)), of(right).value_lengths().to_numpy())[order]  # small cells span tables
        stops = [*starts[1:], len(home)]
        who = np.repeat(np.arange(len(q)), of(left).value_lengths().to_numpy())
        looks = of(left).flatten().to_numpy()
        out = [none]
        for at in range(0, len(q), 512):
            own = (who >= at) & (who < at + 512)
            ii, jj = [], []
            for name, a, b in zip(names, starts, stops):
                i, j = who[own & (looks == name)], order[a:b]
                if len(i):
                    near = q[i] @ x[j].T
                    near[q_ids[i][:, None] == x_ids[j][None, :]] = -np.inf
                    floor = np.partition(near, -k, axis=1)[:, -k] if len(j) > k else np.full(len(i), -np.inf)
                    # a matrix product rounds by a value's place; what may be among the best is summed again, each row alike
                    r, c = np.nonzero((near >= floor[:, None] - 1e-9 * np.maximum(1, np.abs(floor[:, None]))) & (near > -np.inf))
                    ii.append(i[r])
                    jj.append(j[c])
            i, j = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (ii, jj))
            if len(i):
                i, j = np.divmod(np.unique(i * len(x) + j), len(x))
                exact = np.concatenate([(q[i[s : s + 65536]] * x[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)])
                best = np.lexsort((x_ids[j], -exact, i))
                i, j, exact = i[best], j[best], exact[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append(pa.table({"query_id": q_ids[i[keep]], "vec_id": x_ids[j[keep]], "score": exact[keep]}))
        return pa.concat_tables(out)

    key, own = ["axis", "part", "i", "j"], ["id", "buckets", "v"]
    here = asked.select(*[F.col(c).alias(f"q_{c}") for c in (*key, *own)])
    return here.groupBy(*[f"q_{c}" for c in key]).cogroup(filed.select(*key, *own).groupBy(*key)).applyInArrow(
        run, "query_id long, vec_id long, score double"
    )


def op4_cross_polytope(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector, among all others."""
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(rows.where("id % 20 = 0"), rows).select("query_id", "rank", "vec_id", "score")
