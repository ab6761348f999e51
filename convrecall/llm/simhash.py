"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints that differ in at most four bits, cut into three segments, have a segment in which they differ by
at most one bit. So each fingerprint is indexed by its exact segments and by each segment with one bit deleted. An
equality join on those signatures finds every such pair, and the join's condition verifies the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from convrecall.llm.common import checkpoint, components

#: Bits of the segments, lowest first. The distance allowed is twice their number less two.
SEGMENTS = (22, 21, 21)
SHINGLE = 4


def _masks(segments: tuple[int, ...]) -> list[int]:
    out, at = [], 0
    for n in segments:
        m = ((1 << n) - 1) << at
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
        at += n
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these unsigned hashes, signed: a bit is 1 if over half of them have it; none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = text.lower().split()  # of bytes: lower() changes A-Z alone, split() cuts at \x20 and \x09-\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1).tolist()
    stops = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[i:j], 42) for i, j in zip(starts, stops)], dtype="<u8"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every text; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Each pair ``(fa, fb)`` of the distinct fingerprints ``fp`` within the distance, once.

    A pair may meet under several signatures; it is taken under the first segment that differs by at most one bit.
    """
    masks, most = _masks(segments), 2 * len(segments) - 2
    bits = [i for i, n in enumerate(segments) for _ in range(n)]
    # which segment a bit is in, as a fixed array
    seg_of = "array(" + ",".join(map(str, bits)) + ")[bit]"
    mask_of = "array(" + ",".join(f"{m}L" if m > -(1 << 63) else "bigint('-9223372036854775808')" for m in masks) + ")"
    apart = "bit_count(fa ^ fb)"
    earlier = " and ".join(f"(s <= {i} or bit_count((fa ^ fb) & {m}L) >= 2)" for i, m in enumerate(masks[:-1]))
    whole = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.expr(f"fp & {m}L").alias("key")) for i, m in enumerate(masks)])).alias("x")
    ).select("fp", "x.s", "x.key")
    # joins by merge: Spark takes an explode to be as small as what it explodes, and would broadcast millions of rows
    same = whole.withColumnRenamed("fp", "fa").hint("merge").join(
        whole.select(F.col("fp").alias("fb"), F.col("s").alias("s2"), F.col("key").alias("key2")),
        F.expr(f"s = s2 and key = key2 and fa < fb and {apart} <= {most} and {earlier}"),
    )
    one = (
        distinct.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("bit"))
        .withColumn("s", F.expr(seg_of))
        .withColumn("flag", F.expr("shiftleft(1L, bit)"))
        .withColumn("key", F.expr(f"fp & {mask_of}[s] & ~flag"))
    )
    zero = one.where("fp & flag = 0").select(F.col("fp").alias("fa"), "bit", "s", "key")
    unit = one.where("fp & flag <> 0").select(
        F.col("fp").alias("fb"), F.col("bit").alias("bit2"), F.col("key").alias("key2")
    )
    variant = zero.hint("merge").join(unit, F.expr(f"bit = bit2 and key = key2 and {apart} <= {most} and {earlier}"))
    return same.select("fa", "fb").unionByName(variant.select("fa", "fb"))


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for every row of ``docs``.

    ``component_id`` is the smallest doc_id that is reached over links of at most four differing bits. Rows with equal
    fingerprints are brought to one before anything is compared. A null doc_id takes part but never names a group: a
    group of such rows alone has a null component. Repeated rows stay repeated. Other columns are not read.
    """
    fps = checkpoint(fingerprints(docs, shingle))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(first.select("fp")), "fa", "fb")  # of fingerprints, so that those without any doc_id link too
    linked = found.join(first, F.col("node") == F.col("fp")).select("node", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    named = first.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp2"), F.coalesce("least", "first").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("fp2"), "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
