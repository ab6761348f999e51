"""Near-duplicate documents: SimHash groups and farther pairs, each compared by the Jaccard similarity of word shingles.

Texts of one SimHash group (fingerprints of their shingles, linked at up to four bits by deletion-variant signatures)
are candidates. Most pairs of a similarity of 0.8 to 1 differ by more bits; those are candidates by MinHash, where they
agree in one of ``BANDS`` bands of ``ROWS`` minima: a pair of similarity s is missed by it with probability
(1 - s^ROWS)^BANDS, 4e-6 at 0.8, less above. Each candidate is then compared by its shingles. A parity sketch is held
against candidates first: it bounds the shingles that only one of two texts has from below, so it drops no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from convrecall.llm import simhash
from convrecall.llm.common import checkpoint, components

SHINGLE = 5
#: Texts are near where at least NEAR[0] of NEAR[1] shingles of either are in both.
NEAR = (4, 5)
BANDS, ROWS = 24, 4
#: Sets of a band whose pairs are all compared; larger groups are joined by stars first.
FEW = 16
#: Sets of a large group that a task compares with the group's rest.
PART = 1024
#: Texts that may be fetched by a broadcast of their ids; beyond, a join shuffles.
BROADCAST_IDS = 200_000

_RANDOM = np.random.default_rng(42)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_SET = "doc_id long, sig long, k int, bands array<long>, sketch array<long>, fp long"


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of so many words; fewer words are one run; no words have none."""
    words = text.lower().split()  # of bytes, as in simhash
    runs = {xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.sort(np.fromiter(runs, dtype=np.uint64, count=len(runs)))


def signature(hashes: np.ndarray) -> int:
    """A signed hash of the set; 0 where it is empty."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63) if len(hashes) else 0


def bands(hashes: np.ndarray) -> list[int]:
    least = np.full((BANDS * ROWS, 1), (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096] ^ _XOR) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        least = np.minimum(least, mixed.min(1, keepdims=True))
    least = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least)]


def sketch(hashes: np.ndarray) -> list[int]:
    """512 parities of the shingles that fall to a bit: two sets differ in as many shingles as in bits, or more."""
    odd = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1).cast(pa.binary()):
                h = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle)
                made.append((signature(h), len(h), bands(h) if len(h) else [], sketch(h), simhash.majority(h)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "sig", "k", "bands", "sketch", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SET)


def _hashed(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                h = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", shingle)
                yield pa.RecordBatch.from_arrays([pa.array([signature(h)], pa.int64()), pa.array([h.view("<i8")], pa.list_(pa.int64()))], ["sig", "hashes"])

    return docs.select("text").mapInArrow(run, "sig long, hashes array<long>")


def _simhash_groups(sets: DataFrame) -> DataFrame:
    """``(sig, key)``: the group of every set with words, by links of fingerprints as in op8."""
    worded = sets.where("k > 0").select("sig", "fp")
    linked = components(simhash.links(worded.select("fp").distinct()), "fa", "fb")
    return worded.join(linked, F.col("fp") == F.col("node"), "left").select("sig", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("key"))


def _may_be_near(near: tuple[int, int]) -> str:
    """Whether sets x and y can be near by their sizes and sketches, as SQL."""
    p, q = near
    apart = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(8))
    sizes = f"{p} * x.k <= {q} * y.k and {p} * y.k <= {q} * x.k"
    return f"{sizes} and {p + q}L * ({apart}) <= {q - p}L * (x.k + y.k)"


def _verified(docs: DataFrame, first: DataFrame, pairs: DataFrame, shingle: int, near: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose shingles are near."""
    pairs = checkpoint(pairs.distinct())
    wanted = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    n = wanted.count()
    if not n:
        return pairs
    small = F.broadcast if n <= BROADCAST_IDS else lambda df: df
    ids = first.join(small(wanted), "sig", "left_semi").select(F.col("first").alias("doc_id")).where("doc_id is not null")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.join(small(ids), "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    sets = checkpoint(_hashed(rows, shingle).join(small(wanted), "sig", "left_semi").dropDuplicates(["sig"]))
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    either = F.size("hashes_a") + F.size("hashes_b") - both
    return checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").where(near[1] * both >= near[0] * either).select("a", "b"))


def groups(docs: DataFrame, shingle: int = SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """``(doc_id, sig, component_id)``, a row for every row of ``docs``.

    ``component_id`` is the smallest doc_id that is reached over links of near texts. Texts of equal shingles are
    brought to one before anything is compared; wordless and null texts are alike. A null doc_id takes part but never
    names a group: a group of such rows alone has a null component. Other columns are not read.
    """
    found = checkpoint(_sets(docs, shingle))
    sets = checkpoint(found.groupBy("sig").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("k", "bands", "sketch", "fp")]))
    first = sets.select("sig", "first")
    keyed = sets.select("sig", F.explode("bands").alias("key")).unionByName(_simhash_groups(sets))
    shared = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(shared, "key").join(sets.select("sig", "k", "sketch"), "sig")
    met = checkpoint(met.select("key", "n", F.struct("sig", "k", "sketch").alias("x")))
    maybe = _may_be_near(near)

    ends = [F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")]
    few = met.where(F.col("n") <= FEW)
    pairs = few.select("key", "x").join(few.select("key", F.col("x").alias("y")), "key").where(f"x.sig < y.sig and {maybe}")
    many = met.where(F.col("n") > FEW).select("key", "x", F.col("x.sig").alias("sig"))
    hub = many.groupBy("key").agg(F.min_by("x", F.xxhash64("sig")).alias("y"))
    starred = many.join(hub, "key").where(f"sig <> y.sig and {maybe}")
    links = _verified(docs, first, pairs.select(*ends).unionByName(starred.select(*ends)), shingle, near)
    if not many.isEmpty():
        # what no star has reached is compared with all that is not yet in one component with it
        in_one = components(links).select(F.col("node").alias("sig"), "component")
        placed = checkpoint(many.join(in_one, "sig", "left").select("key", "x", "sig", F.coalesce("component", "sig").alias("c")))
        sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
        most = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.ceil(F.sum("n") / PART).alias("parts"), F.count("*").alias("kinds")).where("kinds > 1")
        placed = placed.join(most, "key").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        # of two components, one at least is not the group's largest
        others = placed.where("c <> most").select("key", F.col("x").alias("y"), F.col("c").alias("d"), F.explode(F.expr("sequence(0, cast(parts as int) - 1)")).alias("part"))
        pairs = placed.join(others, ["key", "part"]).where(f"c <> d and {maybe}")
        links = links.unionByName(_verified(docs, first, pairs.select(*ends), shingle, near))

    in_one = components(links).select(F.col("node").alias("sig"), "component")
    named = checkpoint(first.join(in_one, "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("component")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("sig", "component_id")
    return found.select("doc_id", "sig").join(named, "sig").select("doc_id", "sig", "component_id")
