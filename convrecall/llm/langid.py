"""Language of words, spans and whole texts.

A word's script narrows the languages that it may be in; trigrams of its letters score it for each of them; and a
Viterbi pass with a penalty for switching labels the spans of a mixed text. The model is naive Bayes over hashed byte
trigrams, trained by a Spark job on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Trigrams are hashed to so many counters for each language.
BUCKETS = 1 << 15
#: At most about so many labelled rows of each language are learned from (documented bound of the training sample).
SAMPLE = 5_000
#: Languages that are learned at most unless asked otherwise: those of most distinct texts (documented bound of the model).
LANGUAGES = 256
#: What a switch of language costs, in nats.
SWITCH = 12.0
#: A language may be in a script that holds this share of its training letters.
SHARE = 0.01
#: Words of a task's table; when it is full it starts anew.
CACHE = 150_000
#: Characters of the texts that advance together, longest first; a longer text advances alone.
TOGETHER = 3_000_000

# First code points of Unicode script ranges; what is in none of the named scripts is "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})

#: Runs of letters (and of the few number signs that the next test drops).
WORDS = re.compile(r"[^\W\d_]+")


def script(word: str) -> int:
    """Index in NAMES of the script that most letters of a word are in."""
    found = [SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in word if c.isalpha()]
    return NAMES.index(max(sorted(set(found)), key=found.count)) if found else -1


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of words with a space before and behind, and where each word's trigrams begin."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(17)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.where(b[1:-1] == 32, BUCKETS, h), starts  # windows over two words go to a bucket of no weight


@dataclass(frozen=True)
class Model:
    """languages; log-probabilities, BUCKETS + 1 rows (the last 0) by language; which scripts each may be in."""

    languages: tuple[str, ...]
    weights: bytes
    scripts: tuple[tuple[bool, ...], ...]


def train(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model:
    """Learn from ``(text, lang)`` of ``docs``.

    Rows with a null text or lang teach nothing. The ``most`` labels of most distinct texts are learned (ties by name), so
    that bounds the model, one number for each of them and bucket on the driver and in each task. Rarer labels teach
    nothing and are never predicted: their documents get the learned label that fits best. Of each language about
    ``sample`` distinct texts are taken, by a hash of the text, and always that of the least hash; each teaches once,
    however often it is repeated. Counts are summed by Spark.
    """
    rows = docs.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("at")).where("text is not null and lang is not null")
    kinds = rows.select("lang", "at").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    kinds = kinds.orderBy(F.desc("n"), "lang").limit(most).collect()
    if not kinds:
        return Model((), b"", ())
    most = F.create_map(*[F.lit(x) for r in kinds for x in (r["lang"], max(r["least"] + 1, int(min(1.0, sample / r["n"]) * (1 << 40))))])
    rows = rows.where(F.col("at") < most[F.col("lang")]).dropDuplicates(["lang", "at"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                words = WORDS.findall(text.as_py().lower())
                if words:
                    own = seen.setdefault(lang.as_py(), np.zeros(BUCKETS + 1 + len(NAMES), np.int64))
                    own[: BUCKETS + 1] += np.bincount(trigrams(words)[0], minlength=BUCKETS + 1)
                    for w in words:
                        if (s := script(w)) >= 0:
                            own[BUCKETS + 1 + s] += len(w)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                ["lang", "at", "n"],
            )

    summed = rows.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    table = summed.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    full = np.zeros((BUCKETS + 1 + len(NAMES), len(languages)))
    full[table["at"], table["lang"].map(languages.index)] = table["n"]
    grams, letters = full[:BUCKETS], full[BUCKETS + 1 :]
    weights = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    weights[:-1] = np.log((grams + 0.1) / (grams + 0.1).sum(0))
    may = letters >= SHARE * np.maximum(letters.sum(0), 1)
    return Model(languages, weights.tobytes(), tuple(map(tuple, may.tolist())))


class Labeller:
    """Scores and labels of one task."""

    def __init__(self, model: Model):
        self.n = len(model.languages)
        self.weights = np.frombuffer(model.weights, np.float32).reshape(BUCKETS + 1, self.n)
        self.may = np.array(model.scripts)
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, self.n), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def ids(self, words: list[str]) -> list[int]:
        """Rows of ``scores`` and ``letters`` of the words. Only between batches may the table start anew."""
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            new = list({w: 0 for w in words if w not in known})
            at = len(known)
            while at + len(new) > len(self.letters):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            grams, starts = trigrams(new)
            own = np.add.reduceat(self.weights[grams], starts, axis=0)
            scripts = np.fromiter(map(script, new), np.int64, len(new))
            allowed = self.may[scripts]
            none = ~allowed.any(1)  # no learned language is in this script: it speaks for none
            own[~allowed] = -1e6
            own[none | (scripts < 0)] = 0
            self.scores[at : at + len(new)] = own
            self.letters[at : at + len(new)] = [sum(map(str.isalpha, w)) for w in new]
            known.update(zip(new, range(at, at + len(new))))
            return [known[w] for w in words]

    def viterbi(self, ids: list[list[int]], switch: float) -> list[np.ndarray]:
        """The language of each word of each text; all texts advance together, a word at a time."""
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        sizes = np.array([len(ids[i]) for i in order])
        flat = np.fromiter((x for i in order for x in ids[i]), np.int64, sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t words
        best = np.zeros((len(order), self.n), np.float32)
        stays, froms = [], []
        for t in range(longest):
            n = int(active[t])
            own = best[:n]
            came = own.argmax(1)
            floor = own[np.arange(n), came][:, None] - (switch if t else 0)
            stays.append(own >= floor)
            froms.append(came.astype(np.int16))
            np.maximum(own, floor, out=own)
            own -= own.max(1, keepdims=True)
            own += self.scores[flat[starts[:n] + t]]
        labels = np.zeros(len(flat), np.int64)
        now = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = int(active[t])
            labels[starts[:n] + t] = now[:n]
            if t:
                now[:n] = np.where(stays[t][np.arange(n), now[:n]], now[:n], froms[t])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        for i, a, n in zip(order, starts, sizes):
            out[i] = labels[a : a + n]
        return out


def detect(
    docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False, keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every row of ``docs`` and, on demand, ``spans``.

    ``lang_pred`` is the language of most letters, ``score`` its share of them; ties go to the language that sorts
    first. A null text, or one without any letter, is ``und`` with score 0, and so is everything when nothing could
    be learned. ``spans`` are ``(lang, start, stop)`` in code points of the text, from the first to the last word of
    each run. Repeated rows are judged alike; only ``text`` is looked at, what is kept is passed on. The two columns may
    have other ``names``; kept columns that have the name of a new one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets for each language
    new = [*names, "spans"] if spans else list(names)
    keep = tuple(c for c in keep if c not in new)
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")  # texts go to Python once
    read = kept.columns.index("text")
    out = [i for i, c in enumerate(kept.columns) if c in keep]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    types = [T.StringType(), T.DoubleType(), T._parse_datatype_string("array<struct<lang: string, start: int, stop: int>>")]
    schema = T.StructType([*(kept.schema.fields[i] for i in out), *map(T.StructField, new, types)])

    def runs(text: str, labels: np.ndarray, names: tuple[str, ...]) -> list[dict]:
        at = [m.span() for m in WORDS.finditer(text.lower() if len(text.lower()) == len(text) else text)]
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)] if len(labels) else [0]
        return [
            {"lang": names[labels[a]], "start": at[a][0], "stop": at[b - 1][1]}
            for a, b in zip(cuts, cuts[1:])
            if b <= len(at)
        ]

    def together(texts: pa.Array) -> Iterator[list[int]]:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        part, size = [], 0
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if part and size + sizes[i] > TOGETHER:
                yield part
                part, size = [], 0
            part.append(i)
            size += sizes[i]
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own = Labeller(model) if model.languages else None  # a task's own: a worker that waits for another task holds none
        for batch in batches:
            texts = batch.column(read)
            langs, scores, found = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for part in together(texts) if own else ():
                if len(own.known) > CACHE:
                    own._start()
                ids = [own.ids(WORDS.findall((texts[i].as_py() or "").lower())) for i in part]
                for i, words, labels in zip(part, ids, own.viterbi(ids, switch)):
                    share = np.bincount(labels, own.letters[words], own.n) if words else np.zeros(own.n)
                    total = share.sum()
                    if total:
                        langs[i], scores[i] = model.languages[int(share.argmax())], float(share.max() / total)
                        if spans:
                            found[i] = runs(texts[i].as_py(), labels, model.languages)
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(found, kind)] if spans else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), *made], [*(kept_names[i] for i in out), *new])

    kept_names = kept.columns
    return kept.mapInArrow(run, schema)


def held_out() -> F.Column:
    """True where the checksum of the doc_id keeps a row from training; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, by a model that has not seen the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return detect(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
