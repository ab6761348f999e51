"""Ranked lexical search of a set of queries over all documents, by groups of matched terms.

Documents are tokenised once, into a stored table of their terms and frequencies. A task takes documents in blocks. In
a block every document is a bitmap of the query terms that it holds; a query's bits of it are the mask of what they
match, and documents of one mask are a group. A mask's best score follows from the best part of each of its terms, so
groups are scored from the highest bound down, until the next bound is below the k-th score that the task has. What a
task keeps for a query are its k best; the tasks' rows are brought together by windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from convrecall.llm.common import stored

#: A term: ASCII letters and digits and all that is not ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
K = 20
#: Documents that are grouped together.
BLOCK = 2048
#: Characters of the queries that a pass over the documents answers; a longer query has a pass of its own.
PASS = 1 << 22
#: Terms of documents that a task holds before it hands them on; a longer document goes by itself.
TOGETHER = 1 << 16
#: Groups a query's rows are brought together in, before the last window.
SALT = 64
_LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> Counter:
    """Terms of a text with their frequencies; only A-Z are lower-cased."""
    return Counter(TERM.findall((text or "").encode().lower().decode()))  # of bytes: lower() changes A-Z alone


def term_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each document with a term: how many terms it has, and each one with its frequency.

    Null texts and those without terms have no row. Repeated rows stay repeated. Other columns are not read.
    """

    def made(ids: list[int | None], found: list[Counter]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([own.total() for own in found], pa.int64()), pa.array([list(own) for own in found], pa.list_(pa.string())),
             pa.array([list(own.values()) for own in found], pa.list_(pa.int64()))],
            ["doc_id", "n", "terms", "tfs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                if own := terms(text.as_py()):
                    ids.append(doc.as_py())
                    found.append(own)
                    size += len(own)
                    if size >= TOGETHER:
                        yield made(ids, found)
                        ids, found, size = [], [], 0
            yield made(ids, found)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<bigint>")


@dataclass(frozen=True)
class Queries:
    """The queries of a pass: the terms, and for each query the places of its terms with weight times frequency."""

    place: dict[str, int]
    wanted: list[tuple[np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 gives to a document: frequency against length, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best (score, document) that a task has seen for a query."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document scored below it is not among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        fine = score >= self.least
        score, doc = np.concatenate([self.score, score[fine]]), np.concatenate([self.doc, doc[fine]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def search_block(docs: np.ndarray, lengths: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, queries: Queries, best: list[Best]) -> int:
    """Enter a block's documents into ``best``; returns how many were scored.

    ``row``, ``term`` and ``tf`` are the postings of query terms in the block, by row.
    """
    m = 75 + 25 * lengths * queries.n_docs // queries.n_terms
    gives = part(tf, m[row])
    n_words = -(-len(queries.place) // 64)
    bits = np.zeros((len(docs), n_words), np.uint64)
    np.bitwise_or.at(bits, (row, term >> 6), np.uint64(1) << (term & 63).astype(np.uint64))
    most = np.zeros(n_words * 64, np.int64)
    np.maximum.at(most, term, gives)
    begins = np.searchsorted(row, np.arange(len(docs) + 1))
    scored = 0
    for (places, weights), top in zip(queries.wanted, best):
        words = np.unique(places >> 6)
        own = np.zeros((len(words), 64), np.int64)
        own[np.searchsorted(words, places >> 6), places & 63] = weights
        mask = bits[:, words] & np.bitwise_or.reduce((own != 0) * (np.uint64(1) << np.arange(64, dtype=np.uint64)), axis=1, dtype=np.uint64)
        held = np.flatnonzero(mask.any(axis=1))
        if not len(held):
            continue
        keys = np.ascontiguousarray(mask[held]).view(f"V{8 * len(words)}").ravel()
        kinds, group = np.unique(keys, return_inverse=True)
        open_bits = np.unpackbits(kinds.view(np.uint8).reshape(len(kinds), -1), axis=1, bitorder="little")
        bound = open_bits.astype(np.int64) @ (own * most.reshape(-1, 64)[words]).ravel()
        by_bound = np.argsort(-bound, kind="stable")
        members = held[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(kinds)))
        sizes = np.diff(ends, prepend=0)
        full = np.zeros(n_words * 64, np.int64)
        full[places] = weights
        at = 0
        while at < len(by_bound) and bound[by_bound[at]] >= top.least:
            upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[by_bound[at:]]), 2 * top.k))  # masks of a few documents together
            chosen = [g for g in by_bound[at:upto].tolist() if bound[g] >= top.least]
            rows = np.concatenate([members[ends[g] - sizes[g] : ends[g]] for g in chosen])
            spans = begins[rows + 1] - begins[rows]
            of = np.repeat(np.arange(len(rows)), spans)
            here = np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(begins[rows], spans)
            score = np.zeros(len(rows), np.int64)
            np.add.at(score, of, full[term[here]] * gives[here])
            top.add(score, docs[rows])
            scored, at = scored + len(rows), upto
    return scored


def _pass(table: DataFrame, queries: Queries, numbers: list[int], k: int) -> DataFrame:
    """``(query, doc_id, score)``: each task's best documents for each query of a pass."""
    shared = table.sparkSession.sparkContext.broadcast(queries)  # PASS bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = [Best(k) for _ in own.wanted]
        place = pa.array(list(own.place), pa.string())
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                block = batch.slice(begin, BLOCK)
                lists = block.column(2)
                row = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
                term = pc.fill_null(pc.index_in(lists.flatten(), place), -1).to_numpy()
                tf = block.column(3).flatten().to_numpy()
                fine = term >= 0
                docs = block.column(0).fill_null(_LAST).to_numpy()
                search_block(docs, block.column(1).to_numpy(), row[fine], term[fine].astype(np.int64), tf[fine], own, best)
        for number, top in zip(numbers, best):
            ids = pa.array(top.doc, pa.int64(), mask=top.doc == _LAST)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(top.doc), pa.int64()), ids, pa.array(top.score, pa.int64())], ["query", "doc_id", "score"])

    return table.mapInArrow(run, "query long, doc_id long, score long")


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text).

    Scores are whole numbers, see ``part`` and ``weight``; documents scored 0 are not returned, ties go to the smaller
    doc_id. Every row of ``queries`` is a query of its own, and so is every row of ``docs`` a document. Queries without
    terms find nothing, nor does any query where no document has a term. Rows of ``docs`` without a doc_id take part
    and come after those of their score. Other columns are not read. Queries are answered in passes of PASS characters,
    each of which reads the stored table of terms once.
    """
    spark = docs.sparkSession
    table = stored(term_table(docs))
    empty = spark.createDataFrame([], "query long, doc_id long, score long")
    asked = stored(term_table(queries.select(F.col("item_id").alias("doc_id"), "text")).withColumn("query", F.monotonically_increasing_id()))
    total = table.agg(F.count("*"), F.sum("n")).first()
    if not total[0]:
        return _best(empty, k, "query").select(F.col("query").alias("item_id"), "rank", "doc_id", "score")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = table.select(F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    each = asked.select("query", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("query", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    found = each.join(df, "term")
    size = F.sum(F.length("term") + 8)
    weighed = stored(found.groupBy("query").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"), size.alias("size")))
    n_passes = max(1, math.ceil((weighed.agg(F.sum("size")).first()[0] or 0) / PASS))
    made = None
    for i in range(n_passes):
        place: dict[str, int] = {}
        of, numbers = [], []
        for r in weighed.where(F.pmod(F.xxhash64("query"), F.lit(n_passes)) == i).toLocalIterator():
            own = [(place.setdefault(t.term, len(place)), w * t.tf) for t in r.terms if (w := weight(total[0], t.df))]
            if own:
                of.append(tuple(np.array(x, np.int64) for x in zip(*own)))
                numbers.append(r["query"])
        if of:
            one = _pass(table, Queries(place, of, total[0], total[1]), numbers, k)
            made = one if made is None else made.unionByName(one)
    near = _best((empty if made is None else made).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))), k, "query", "salt").drop("rank")
    names = asked.select("query", F.col("doc_id").alias("item_id"))
    return _best(near, k, "query").join(names, "query").select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""WITH tok AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), docs AS (SELECT doc_id, r, t, len(t) AS n FROM tok WHERE len(t) > 0
), total AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM docs
), post AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY ALL
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM post, total GROUP BY term
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), lengths AS (SELECT doc_id, r, 75 + (25 * n * N_docs) // L AS m FROM docs, total
), scored AS (
  SELECT i.item_id, l.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items i JOIN weights USING (term) JOIN post USING (term) JOIN lengths l USING (r) GROUP BY i.item_id, l.doc_id, l.r
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
