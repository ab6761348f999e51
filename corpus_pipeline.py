"""A training corpus from raw documents: languages, repeated lines, near-duplicates, the mixture, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from convrecall.llm import bpe, langid, linededup, mixing, neardup
from convrecall.llm.common import put_aside, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it in ``lang``. Texts that are null or have no letter go.

    The model learns from labelled rows outside the held-out quarter. Where nothing is labelled, all are rejected.
    """
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.detect(docs, model, keep=tuple(docs.columns), names=("lang__found", "score__found")).where("lang__found <> 'und'")
    return found.withColumn("lang", F.col("lang__found")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat, to within an edit, a line of an earlier one; ``n_chars`` follows."""
    own, back = put_aside(docs, ("n_lines", "n_removed"))
    made = linededup.dedup_lines(own)
    return made.withColumn("n_chars", F.length("text").cast("long")).drop("n_lines", "n_removed").withColumnsRenamed(back).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Candidates are the SimHash groups and, for what is more bits apart, MinHash bands; each is compared exactly.
    Of rows that share a doc_id one stays. Rows without a doc_id cannot be named, so they stay.
    """
    first = neardup.groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the production mixture, each at most once."""
    new = ("domain", "tokens", "epoch", "budget")
    own, back = put_aside(docs, new)
    made = mixing.mixed(own, mixing.domain_of(), mixing.tokens_of(), mixing.SHARE, mixing.WEIGHTS)
    return made.drop(*new).withColumnsRenamed(back).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and the digest of what they decode to."""
    import public_tokenizers

    model = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), model, public_tokenizers.PATTERN)
    return made.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Languages, fingerprints and merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
