"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 of a file has the first chunk of every token, level 1 the
second chunk of those that have one, and so on. A bitmap of each level marks the tokens that go on, and a directory
holds the number of marks before every 512th bit. So the place of a token on the next level is its rank among the
marks: any token is read by a few reads of some bytes, and no block is decoded.

A file holds whole documents in order, with their ids and ends. Files have names of their own for each attempt, and a
table that Spark commits names those that count: a lost executor leaves files that nothing refers to.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from convrecall.llm.bpe import byte_chars
from convrecall.llm.common import shared_folder

MAGIC = b"DACTOK01"
HEAD = struct.Struct("<8sQQQ")
#: Bits of a chunk, and bits of a bitmap between entries of its directory.
CHUNK, STEP = 8, 512
#: Tokens of a file, beyond which the next document begins another one.
FILE_TOKENS = 1 << 25
#: Tokens that are written or read together; a longer document is read by itself.
TOGETHER = 1 << 20
#: Entries of a worker's tables of words; one that is full starts anew. Longer words are not entered.
CACHE, LONG = 600_000, 64
# How a tokenizer of the plain kind changes and splits texts.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters up to U+024F (but for one that two characters are lower-cased to), between ASCII signs other than apostrophes.
SIMPLE = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
MANIFEST = "shard int, seq int, path string, n_docs long, n_tokens long"


class Encoder(dict):
    """A tokenizer with a table of the words that it has encoded, words being what white space separates.

    A tokenizer of the PLAIN kind need not see runs of letters whose case alone changes, with signs before or behind:
    those are split, as it would do, and merged by its model.
    """

    def __init__(self, spec: str, end: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.end = b"" if end is None else struct.pack("<I", end)
        self.pieces: dict[str, bytes] = {}
        self.chars = dict(enumerate(byte_chars()))
        made = json.loads(spec)
        self.added = [x["content"] for x in made["added_tokens"]]  # found in texts before they are split
        self.plain = made["normalizer"] == PLAIN["normalizer"] and made["pre_tokenizer"] == PLAIN["pre_tokenizer"]

    def _merged(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(piece) <= LONG:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        split = SIMPLE(text) if self.plain and not any(x in text for x in self.added) else None
        if split:
            before, core, behind = split.groups()
            ids = self._merged(core.lower())
            if before or behind:
                ids = b"".join([self._merged(before) if before else b"", ids, self._merged(behind) if behind else b""])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, (text or "").encode().split())) + self.end  # split of bytes: ASCII white space alone


@lru_cache(maxsize=1)
def encoder(spec: str, end: int | None) -> Encoder:
    """The encoder of a worker, which its tasks use in turn."""
    return Encoder(spec, end)


class Writer:
    """Collects the documents of a file, as levels."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.waiting: list[bytes] = []
        self.n_tokens = self.n_waiting = 0
        self.chunks: list[list[np.ndarray]] = []
        self.marks: list[list[np.ndarray]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.n_tokens += len(ids) // 4
        self.n_waiting += len(ids) // 4
        self.docs.append(doc)
        self.ends.append(self.n_tokens)
        self.waiting.append(ids)
        if self.n_waiting >= TOGETHER:
            self._split()

    def _split(self) -> None:
        rest, level = np.frombuffer(b"".join(self.waiting), "<u4"), 0
        self.waiting, self.n_waiting = [], 0
        while len(rest):
            if level == len(self.chunks):
                self.chunks.append([])
                self.marks.append([])
            more = rest >> CHUNK > 0
            self.chunks[level].append((rest & 255).astype(np.uint8))
            self.marks[level].append(more)
            rest, level = rest[more] >> CHUNK, level + 1

    def write(self, out: pa.NativeFile) -> None:
        self._split()
        sizes = [sum(map(len, c)) for c in self.chunks]
        out.write(HEAD.pack(MAGIC, len(self.docs), self.n_tokens, len(sizes)))
        out.write(np.array(sizes, "<u8").tobytes())
        out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        out.write(np.array(self.ends, "<u8").tobytes())
        for chunks, marks in zip(self.chunks, self.marks):
            bits = np.concatenate(marks)
            for c in chunks:
                out.write(c.tobytes())
            out.write(np.packbits(np.pad(bits, (0, -len(bits) % STEP)), bitorder="little").tobytes())
            sums = np.add.reduceat(bits, np.arange(0, len(bits), STEP), dtype=np.int64)
            out.write((np.cumsum(sums) - sums).astype("<u8").tobytes())


class Reader:
    """Random access to the tokens of a file; ``at(n, offset)`` reads bytes of it."""

    def __init__(self, file: pa.NativeFile):
        self.at = lambda n, offset: file.read_at(n, offset)
        magic, self.n_docs, self.n_tokens, levels = HEAD.unpack(self.at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.sizes = np.frombuffer(self.at(8 * levels, HEAD.size), "<u8").tolist()
        self.index = HEAD.size + 8 * levels
        self.places, here = [], self.index + 17 * self.n_docs
        for n in self.sizes:
            bits, ranks = here + n, here + n + -(-n // STEP) * STEP // 8
            self.places.append((here, bits, ranks))
            here = ranks + -(-n // STEP) * 8

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and where each one begins; the last entry is the number of tokens."""
        n = self.n_docs
        docs, named = np.frombuffer(self.at(8 * n, self.index), "<i8").tolist(), self.at(n, self.index + 8 * n)
        ends = np.frombuffer(self.at(8 * n, self.index + 9 * n), "<u8").astype(np.int64)
        return [d if known else None for d, known in zip(docs, named)], np.concatenate([[0], ends])

    def rank(self, level: int, i: int) -> int:
        """Marks of a level before its entry ``i``: an entry of the directory and at most 64 bytes of the bitmap."""
        _, bits, ranks = self.places[level]
        if i >= self.sizes[level]:
            return self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
        block = i // STEP
        before = int.from_bytes(self.at(8, ranks + 8 * block), "little")
        part = int.from_bytes(self.at(i % STEP // 8 + 1, bits + block * STEP // 8), "little")
        return before + (part & ((1 << i % STEP) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The token at ``i`` of the file, by a chunk, a mark and a rank on each level it has."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.places[level]
            value |= self.at(1, chunks + i)[0] << CHUNK * level
            if not self.at(1, bits + i // 8)[0] >> i % 8 & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def tokens(self, i: int, j: int) -> np.ndarray:
        """The tokens from ``i`` up to ``j`` of the file: a slice of each level."""
        out = np.zeros(j - i, "<u4")
        of = np.arange(j - i)
        for level, (chunks, bits, _) in enumerate(self.places):
            if j <= i:
                break
            out[of] |= np.frombuffer(self.at(j - i, chunks + i), np.uint8).astype("<u4") << np.uint32(CHUNK * level)
            marks = np.unpackbits(np.frombuffer(self.at((j - 1) // 8 - i // 8 + 1, bits + i // 8), np.uint8), bitorder="little")[i % 8 :][: j - i]
            of = of[marks.astype(bool)]
            i = self.rank(level, i)
            j = i + len(of)
        return out


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write(docs: DataFrame, folder: str, spec: str, end: int | None = 1, file_tokens: int = FILE_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``folder``, in ascending order of doc_id.

    ``spec`` is the tokenizer in its JSON form and ``end`` the id that ends each document. Null texts are empty. Rows
    without a doc_id come first; rows of one doc_id are in the order of a hash of their text, so that a doc_id that many
    rows share is dealt to several tasks. Other columns are not read. A tokenizer must drop white space. ``folder`` must
    be one that executors can open by pyarrow: a shared path, HDFS, S3, GCS.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    shared = spark.sparkContext.broadcast(spec)  # the tokenizer alone: its size doesn't grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, seq, now = encoder(shared.value, end).encode, TaskContext.get().partitionId(), 0, Writer()
        store, inner = _opened(f"{base}/ids")

        def close() -> pa.RecordBatch:
            name = f"{shard:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            store.create_dir(inner, recursive=True)
            with store.open_output_stream(f"{inner}/{name}") as out:
                now.write(out)
            row = {"shard": shard, "seq": seq, "path": f"{base}/ids/{name}", "n_docs": len(now.docs), "n_tokens": now.n_tokens}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if now.n_tokens >= file_tokens:
                    yield close()
                    now, seq = Writer(), seq + 1
                now.add(doc.as_py(), encode(text.as_py()))
        if now.docs:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/files")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, n_docs, n_tokens, start)`` of the files that count; ``start`` is the number of tokens before each one."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0)))
    own = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    return rows.join(shards.select("shard", "base"), "shard").select("path", "n_docs", "n_tokens", (F.col("base") + F.col("own")).alias("start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files of ``folder``.

    ``start`` is the number of tokens of all documents before it, and ``ids`` are little-endian unsigned 32-bit integers.
    """
    rows = files(spark, folder)
    each = max(1, rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = _opened(row["path"])
                with store.open_input_file(inner) as file:
                    reader = Reader(file)
                    docs, at = reader.documents()
                    i = 0
                    while i < len(docs):
                        j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, "right")) - 1)
                        ids = reader.tokens(int(at[i]), int(at[j])).tobytes()
                        cuts = ((at[i : j + 1] - at[i]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[i:j], pa.int64()), pa.array(at[i:j] + row["start"]), pa.array(np.diff(at[i : j + 1])), pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        i = j

    return rows.repartitionByRange(each, "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame, parts: int = 16) -> DataFrame:
    """``(position, token)`` for each row of ``positions`` (position), counted over all files; others have no row.

    A position meets its file by an equality join on blocks of positions. Tokens are read one by one, without decoding
    what is around them. A file that many positions are in is opened by up to ``parts`` tasks.
    """
    block = F.lit(FILE_TOKENS)
    spans = files(spark, folder).where("n_tokens > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)))
    )
    met = positions.select(F.col("position").cast("long")).withColumn("block", F.floor(F.col("position") / block)).join(spans, "block")
    met = met.where("position >= start and position < start + n_tokens").select("path", (F.col("position") - F.col("start")).alias("own"), "position")
    met = met.repartition("path", F.pmod(F.xxhash64("own"), F.lit(parts))).sortWithinPartitions("path", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, reader = None, None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file:
                        file.close()
                    path = row["path"]
                    store, inner = _opened(path)
                    file = store.open_input_file(inner)
                    reader = Reader(file)
                made.append(reader.token(row["own"]))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(made, pa.int64())], ["position", "token"])
        if file:
            file.close()

    return met.mapInArrow(run, "position long, token long")


def op12_token_store(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's place in the files of ids, and the checksum of what is read back from them."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, spec)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
