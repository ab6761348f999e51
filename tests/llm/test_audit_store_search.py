"""The audit of filters, files of token ids and ranked search, against loops and libraries."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convrecall.llm import audit, lexical, tokenstore

from .test_operators import ODD, SF, docs_of

LABEL = "doc_id long, quality int, toxic int"

# 11


def failed(rows, k):
    doc, text, _ = rows[k]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    out += "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * any(doc is not None and d is not None and d < doc and (t or "") == text for d, t, _ in rows)


def slow_audit(rows, labels):
    marks = [failed(rows, k) for k in range(len(rows))]
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    out = {}
    for part in {s or "" for *_, s in rows}:
        own = [(rows[k][0], marks[k]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(d, m) for d, m in left if x in m]
                left = [(d, m) for d, m in left if x not in m]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in m for _, m in own) - len(gone), sum(m == x for _, m in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_loop(spark):
    rnd = random.Random(11)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, long + " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", long + "#", "a " * 300, "Short", "", None, "\x0b\x0c", "A|B " * 150, "é" * 40, "\x00x\x85y"]
    rows = [(rnd.choice([None, *range(12)]), rnd.choice(texts), rnd.choice(["s", "t", "", None])) for _ in range(120)]
    rows += [(50, long, "s"), (50, long, "s"), (50, "other", "t"), (49, long, None), *[(i, t, "odd") for i, t in ODD]]
    labels = [(rnd.choice([None, *range(12)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(20)] + [(50, 1, 0), (50, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("part", "mask", "key", "n", "quality", "at", "salt")})
    got = audit.interactions(audit.failures(docs, spark.createDataFrame(labels, LABEL).withColumn("text", F.lit("x")))).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == slow_audit(rows, labels) and len(got) == 600 * 4


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABEL)
    docs = docs_of(spark, ODD)
    assert audit.interactions(audit.failures(docs.limit(0), none)).count() == 0
    assert audit.interactions(audit.failures(docs, none)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_given_cells(spark):
    """Counts alone: two filters, one of which takes all that the other takes."""
    rows = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 0), ("p", 3, 3, 0, 2), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(rows, "AB").collect()}
    assert got == {("AB", 1): (5, 6, 0, 2, 1, 2, 8), ("AB", 2): (5, 0, 4, 0, 0, 0, 4), ("BA", 1): (7, 4, 0, 0, 0, 2, 4), ("BA", 2): (5, 2, 4, 2, 1, 0, 8)}


# 12


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_encoder_is_the_library(spec):
    from tokenizers import Tokenizer

    other, own = Tokenizer.from_str(spec), tokenstore.Encoder(spec, 1)
    rnd = random.Random(12)
    signs = [*" \t\n\x0b\x1c'.,;!<>|=~^`\"()abzAZ\x00\x7f\x85\xa0", *"éÉñßİıǅΣσς½²１٣̸́…中", "\U0001f600", "<|endoftext|>", "'s", "word", "WORD", "ŉ", "ẞ", "≠"]
    texts = ["", "x<|endoftext|>", "<|endoftext|>", "'S 'sword it's \"x'll\"", "A" * 3000 + "é" * 2000, *("".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(4000))]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode(t, add_special_tokens=False).ids + [1], t


def test_full_tables_start_anew(spec, monkeypatch):
    monkeypatch.setattr(tokenstore, "CACHE", 3)
    few = tokenstore.Encoder(spec, None)
    words = "alpha beta gamma delta, alpha! beta gamma (epsilon) zeta alpha"
    assert [few.encode(w) for w in (words, words, words[:20])] == [tokenstore.Encoder(spec, None).encode(w) for w in (words, words, words[:20])]
    assert max(len(few), len(few.pieces)) <= 3


def test_random_access(tmp_path):
    rnd = np.random.default_rng(12)
    for n, top in ((0, 1), (1, 1), (5, 1 << 9), (513, 1 << 8), (3000, 1 << 17), (2000, 1 << 32)):
        docs = np.split(rnd.integers(0, top, n, dtype=np.uint64).astype("<u4"), sorted(rnd.integers(0, n + 1, 4).tolist()))
        made = tokenstore.Writer()
        for i, ids in enumerate(docs):
            made.add(None if i == 1 else i - 2, ids.tobytes())
        with pa.OSFile(str(tmp_path / "x"), "wb") as out:
            made.write(out)
        with pa.OSFile(str(tmp_path / "x"), "rb") as file:
            reader, whole = tokenstore.Reader(file), np.concatenate(docs)
            names, at = reader.documents()
            assert names == [-2, None, 0, 1, 2] and np.diff(at).tolist() == [*map(len, docs)] and reader.n_tokens == n
            assert reader.tokens(0, n).tolist() == whole.tolist()
            assert [reader.token(i) for i in range(n)] == whole.tolist()
            for i, j in np.sort(rnd.integers(0, n + 1, (20, 2)), axis=1).tolist():
                assert reader.tokens(i, j).tolist() == whole[i:j].tolist()
            with pytest.raises(IndexError):
                reader.token(n)


@pytest.mark.parametrize("file_tokens", [1, 300, 1 << 25])
def test_store_by_library(spark, spec, tmp_path, file_tokens):
    from tokenizers import Tokenizer

    other = Tokenizer.from_str(spec)
    rows = [*ODD, *((20 + i % 7, f"text number {i} " * i) for i in range(40)), (-5, "before all"), (None, "a second without an id")]
    tokenstore.write(docs_of(spark, rows), str(tmp_path / "t"), spec, 1, file_tokens)
    got = tokenstore.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = lambda t: other.encode(t or "", add_special_tokens=False).ids + [1]
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t in rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1] and all(4 * r.n_tokens == len(r.ids) for r in got)
    whole = [t for r in got for t in np.frombuffer(r.ids, "<u4").tolist()]
    asked = [0, 1, 1, len(whole) - 1, len(whole), -1, None, *range(5, len(whole), 97)]
    found = tokenstore.tokens_at(spark, str(tmp_path / "t"), spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert Counter((r.position, r.token) for r in found) == Counter((p, whole[p]) for p in asked if p is not None and 0 <= p < len(whole))


def test_store_of_nothing(spark, spec, tmp_path):
    tokenstore.write(docs_of(spark, ODD).limit(0), str(tmp_path / "t"), spec)
    assert tokenstore.read(spark, str(tmp_path / "t")).count() == 0
    assert tokenstore.tokens_at(spark, str(tmp_path / "t"), spark.createDataFrame([(0,)], "position long")).count() == 0


def test_op12(spark, spec):
    from tokenizers import Tokenizer

    other, start = Tokenizer.from_str(spec), 0
    got = {r.doc_id: r for r in tokenstore.op12_token_store(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = other.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# 13


def by_sql(queries, docs):
    db = duckdb.connect()
    db.register("benchmark", pd.DataFrame(queries, columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    return Counter(tuple(None if pd.isna(x) else int(x) for x in r) for r in db.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP13_SQL})").fetchall())


def found(spark, queries, docs):
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumns({c: F.lit("mine") for c in ("query", "doc_id", "n", "terms", "rank")})
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(asked, docs_of(spark, docs)).collect())


@pytest.mark.parametrize("block, length", [(2048, 1 << 22), (7, 60)])
def test_search_by_sql(spark, monkeypatch, block, length):
    """Few words, so that masks, ties and repeated texts abound; also with many blocks and passes."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PASS", length)
    rnd = random.Random(13)
    words = ["the", "The", "été", "ÉTÉ", "a1", "x_y", "中文", "rare", *(f"w{i}" for i in range(90))]
    some = lambda n: " ".join(words[min(int(rnd.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, some(rnd.randrange(1, 60))) for i in range(300)] + [(300 + i, "rare rare words") for i in range(30)] + [(5, some(5)), *ODD]
    queries = [(i, some(rnd.randrange(1, 80))) for i in range(12)] + [(20, "rare"), (21, None), (22, ""), (23, "unheard"), (24, "the " * 50), (None, "w3 w4"), (20, "w1")]
    queries = [q for q in queries if q != (20, "w1")]
    assert found(spark, queries, docs) == by_sql(queries, docs)


def test_search_of_nothing(spark):
    assert not found(spark, [(1, "a")], []) and not found(spark, [], [(1, "a")]) and not found(spark, [(1, "a")], [(1, None), (2, "...")])


def test_every_row_is_a_query(spark):
    got = found(spark, [(1, "alpha"), (1, "beta")], [(1, "alpha beta"), (2, "beta"), (3, "gamma"), (4, "gamma")])
    assert sorted((item, rank, doc) for item, rank, doc, _ in got.elements()) == [(1, 1, 1), (1, 1, 2), (1, 2, 1)]


def test_groups_are_skipped(spark):
    """Groups whose bound is below the k-th score are not scored, and nothing is lost by it."""
    rnd = np.random.default_rng(13)
    n, held = 4000, rnd.random((4000, 12)) < 1 / (2 + np.arange(12) ** 1.5)
    row, term = np.nonzero(held)
    tf = rnd.integers(1, 4, len(row))
    weights = np.array([lexical.weight(n, d) for d in held.sum(0)])
    queries = lexical.Queries({str(i): i for i in range(12)}, [(np.arange(12), weights)], n, 20 * n)
    lengths = rnd.integers(10, 40, n)
    best = [lexical.Best(20)]
    scored = lexical.search_block(np.arange(n), lengths, row, term, tf, queries, best)
    m = 75 + 25 * lengths * n // (20 * n)
    slow = np.zeros(n, np.int64)
    for r, t, f in zip(row.tolist(), term.tolist(), tf.tolist()):
        slow[r] += int(weights[t]) * (1_000_000_000 * f // (1000 * f + 12 * int(m[r])))
    order = np.lexsort((np.arange(n), -slow))[:20]
    assert best[0].doc.tolist() == order.tolist() and best[0].score.tolist() == slow[order].tolist()
    assert scored < n / 4


def test_weight():
    assert lexical.weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and lexical.terms("A-a_É é９ \x00x") == Counter({"a": 2, "É": 1, "é９": 1, "x": 1})
