"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks.

Every byte is mapped to a printable character, so that each token becomes a piece of ordinary text. Pieces are scored
by negative rank: the processor merges the best-scored pair first, which is the pair of lowest rank. The normaliser is
the identity. Each match of the pre-token pattern is encoded by itself, and ids are decoded by the inverse map.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Entries of a task's table of encoded pre-tokens; when it is full it starts anew. Longer pre-tokens are not entered.
CACHE = 100_000
LONG = 64
#: Bytes of text that are encoded and decoded before they are handed on; a longer text goes by itself.
TOGETHER = 1 << 20


def byte_chars() -> list[str]:
    """A visible character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model, in its protocol-buffer form, whose piece ids are the ranks.

    Ranks must be 0 to n-1. The piece for unknown text comes after them; no text needs it, as each byte is a token.
    """
    chars = byte_chars()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n-1 and every byte must be a token")
    normal, unknown, bpe = 1, 2, 2
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -rank)
        out.append(_field(1, _field(1, piece) + score + _field(3, normal)))
    out.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))  # no begin, end or padding
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))  # no prefix, nothing removed
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_chars()
        self.chars = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        n = self.processor.get_piece_size() - 1
        self.tokens = [bytes(map(back.__getitem__, self.processor.id_to_piece(i))) for i in range(n)]
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _found(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words that are not in the table; short ones are entered."""
        found, hard = {}, []
        for w in words:
            ids = self.whole.get(w.encode())  # a pre-token that is itself a token is not merged
            if ids is None:
                hard.append(w)
            else:
                found[w] = ids
        mapped = [w.encode().decode("latin-1").translate(self.chars) for w in hard]
        for w, ids in zip(hard, self.processor.encode(mapped, out_type=int, num_threads=1) if hard else ()):
            found[w] = np.array(ids, dtype="<u4").tobytes()
        if len(self.known) + len(found) > CACHE:
            self.known.clear()
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONG)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            kinds = set(words)
            own = {w: self.known[w] for w in kinds if w in self.known}
            own.update(self._found(kinds - own.keys()))
            return b"".join(map(own.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """The column in pieces of about TOGETHER bytes, in order."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > begin and size + n > TOGETHER:
            yield column.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(column):
        yield column.slice(begin)


def _apply(df: DataFrame, column: str, out: list[str], model: bytes, pattern: str, step: Callable[[Codec, object], list[bytes]]) -> DataFrame:
    """``df`` with the columns ``out``, which ``step`` makes of a value, in the place of ``column``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the vocabulary alone: its size doesn't grow with the data
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)  # a task's own: a worker that waits for another task holds none
        for batch in batches:
            begin = 0
            for part in _parts(batch.column(at)):
                made = [step(codec, x.as_py()) for x in part]
                own = batch.slice(begin, len(part))
                begin += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*(c for i, c in enumerate(own.columns) if i != at), *(pa.array([m[k] for m in made], pa.binary()) for k in range(len(out)))],
                    [*(n for i, n in enumerate(batch.schema.names) if i != at), *out],
                )

    rest = [f for f in df.schema.fields if f.name != column]
    return df.mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.BinaryType()) for c in out)]))


def load(path: str) -> bytes:
    """The serialised model of a rank file."""
    with open(path, "rb") as f:
        return serialise(read_ranks(f.read()))


def encode(df: DataFrame, model: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by the binary column ``ids``: little-endian unsigned 32-bit token ids.

    Null text counts as empty and gives no ids. Nothing is shuffled; every row stays where it is, repeats included.
    Strings that look like special tokens are ordinary text.
    """
    return _apply(df, text, [ids], model, pattern, lambda codec, x: [codec.encode(x or "")])


def decode(df: DataFrame, model: bytes, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by the binary column ``raw``, the bytes that the ids stand for. Null gives none."""
    return _apply(df, ids, [raw], model, pattern, lambda codec, x: [codec.decode(x or b"")])


def encode_and_decode(df: DataFrame, model: bytes, pattern: str, text: str = "text", ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """``encode`` with, beside the ids, the bytes ``raw`` that they decode to: one pass, one codec for each task."""

    def both(codec: Codec, x: str | None) -> list[bytes]:
        made = codec.encode(x or "")
        return [made, codec.decode(made)]

    return _apply(df, text, [ids, raw], model, pattern, both)


def round_trip(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row of ``docs``."""
    return encode_and_decode(docs.select("doc_id", "text"), model, pattern)


def op7_byte_bpe(spark, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every document."""
    import public_tokenizers

    model = load(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, model, pattern or public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
