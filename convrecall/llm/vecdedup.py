"""Near-duplicate vectors by PCA-ordered, tiled comparison.

Unit vectors are turned onto the principal axes of the corpus, so that leading dimensions hold most. Tiles of the
order by the first axis are compared pairwise; tiles whose first coordinates are too far apart never meet. Within a
pair of tiles products are accumulated from the leading dimensions; the rest of a product is bounded by the norms of
the suffixes, and pairs that cannot reach the threshold any more are given up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convrecall.llm.ann import lengths, matrix, unit, usable
from convrecall.llm.common import checkpoint, components

THRESHOLD = 0.95
#: Vectors of a tile.
TILE = 2048
#: Dimensions after which a product's rest is bounded, again and again.
STEP = 16
#: Pairs whose coordinates are gathered at a time.
SLAB = 1 << 17


def principal_axes(rows: DataFrame) -> np.ndarray:
    """Eigenvectors of the second moments of the unit vectors, largest first. Sums of products are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0))
                total = total + x.T @ x
        if not np.isscalar(total):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"]
            )

    sums = rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    full = np.zeros((sums["i"].max() + 1,) * 2)
    full[sums["i"], sums["j"]] = sums["s"]  # dimensions squared, whatever the rows
    return np.linalg.eigh((full + full.T) / 2)[1][:, ::-1]


def _unit(column: pa.Array) -> np.ndarray:
    return unit(matrix(column))


def _tiles(distinct: DataFrame, turn: np.ndarray, tile: int) -> DataFrame:
    """``(id, v, copies, lead, tile)``: rows dealt into tiles of neighbours by their first coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = _unit(batch.column(1)) @ turn[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], [*batch.schema.names, "lead"])

    kind = distinct.schema["v"].dataType.simpleString()
    led = checkpoint(distinct.select("id", "v", "copies").mapInArrow(run, f"id long, v {kind}, copies long, lead double"))
    # counts of narrow strips of the axis, at most 4096 whatever the rows, give each row's place to within a strip
    led = led.withColumn("strip", F.least(F.floor((F.col("lead") + 1) * 2048), F.lit(4095)).cast("int"))
    strips = led.groupBy("strip").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strips = strips.select("strip", before.alias("before"), "n")
    place = F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))  # any order within a strip will do
    return led.join(F.broadcast(strips), "strip").select("id", "v", "copies", "lead", F.floor(place / tile).cast("int").alias("tile"))


def _pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, a <= b: tiles whose first coordinates come near enough, by an equality join on cells of the axis."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # unit vectors of this cosine are no farther apart
    ends = tiles.groupBy("tile").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    cell = lambda c: F.floor(c / reach).cast("int")
    a = ends.select(F.col("tile").alias("a"), "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    b = ends.select(
        F.col("tile").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
        F.explode(F.sequence(cell(F.col("lo") - reach), cell(F.col("hi") + reach))).alias("cell"),
    )
    near = a.join(b, "cell").where((F.col("lo2") <= F.col("hi") + reach) & (F.col("hi2") >= F.col("lo") - reach))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y, both turned unit vectors, whose product is at least the threshold."""
    out_i, out_j = [], []
    tails = [[np.sqrt(np.maximum(0, 1 - (z[:, :d] ** 2).sum(1))) for d in range(STEP, z.shape[1], STEP)] for z in (x, y)]
    slab = max(1, SLAB // max(1, len(y)))  # all its pairs may be alive
    for at in range(0, len(x), slab):
        own = x[at : at + slab]
        sums = own[:, :STEP] @ y[:, :STEP].T
        if tails[0]:
            i, j = np.nonzero(sums + tails[0][0][at : at + slab, None] * tails[1][0] >= threshold - 1e-9)
        else:
            i, j = np.nonzero(sums >= threshold - 1e-9)
        part = sums[i, j]
        for s, d in enumerate(range(STEP, x.shape[1], STEP)):
            part = part + (own[i, d : d + STEP] * y[j, d : d + STEP]).sum(1)
            bound = part + tails[0][s + 1][at + i] * tails[1][s + 1][j] if s + 1 < len(tails[0]) else part
            alive = bound >= threshold - 1e-9
            i, j, part = i[alive], j[alive], part[alive]
        out_i.append(at + i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(tiles: DataFrame, pairs: DataFrame, turn: np.ndarray, threshold: float) -> DataFrame:
    """From each pair of tiles: ``(id, n, other)``: links of a vector, and a vector that it is joined with."""

    def run(rows: pa.Table) -> pa.Table:
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        x = _unit(rows.column("v").combine_chunks())
        z = x @ turn
        first, same = rows.column("first").to_numpy(zero_copy_only=False), bool((rows.column("a").to_numpy() == rows.column("b").to_numpy()).all())
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        i, j = near_pairs(z[left], z[right], threshold)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        fine = np.concatenate(
            [(x[i[at : at + 65536]] * x[j[at : at + 65536]]).sum(1) >= threshold for at in range(0, len(i), 65536)] or [np.zeros(0, bool)]
        )
        i, j = i[fine], j[fine]
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        label = _least_labels(len(ids), i, j)
        at = np.flatnonzero(n)
        return pa.table({"id": ids[at], "n": n[at].astype(np.int64), "other": ids[label[at]]})

    a = tiles.join(pairs.withColumnRenamed("a", "tile").withColumn("a", F.col("tile")), "tile").withColumn("first", F.lit(True))
    b = tiles.join(pairs.where("a <> b").withColumnRenamed("b", "tile").withColumn("b", F.col("tile")), "tile")
    both = a.unionByName(b.withColumn("first", F.lit(False)))
    return both.select("a", "b", "first", "id", "v", "copies").groupBy("a", "b").applyInArrow(run, "id long, n long, other long")


def near_vectors(vectors: DataFrame, id_: str, vector: str, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)``: a row for every row of ``vectors``.

    Vectors link when their cosine, in double precision, is at least ``threshold`` (above 0). Equal vectors are brought
    to one first and count as often as they occur. ``component_id`` is the smallest id that links lead to. Rows whose
    vector is null, zero or has null or non-finite components, and rows without an id, link with nothing and are kept.
    Of rows that share an id one vector is compared, and each gets its result. Vectors of unlike lengths never link; each
    length is compared by itself.
    """
    own = vectors.select(F.col(id_).cast("long").alias("id"))
    rows = checkpoint(usable(vectors, id_, vector))
    kinds = [_linked(rows.where(F.size("v") == d), threshold, tile) for d in lengths(rows)]
    if not kinds:
        return own.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    out = own.join(rows.join(reduce(DataFrame.unionByName, kinds), "v").drop("v"), "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _linked(rows: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``(v, n_links, component_id)`` of the distinct vectors of ``rows``, which have one length."""
    distinct = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    turn = principal_axes(rows)
    tiles = checkpoint(_tiles(distinct, turn, tile))
    found = checkpoint(_compared(tiles, _pairs(tiles, threshold), turn, threshold))
    joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    both = tiles.select("id", "v", "copies").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    return both.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at cosine 0.95."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(rows, "vec_id", "embedding").withColumnRenamed("id", "vec_id")
