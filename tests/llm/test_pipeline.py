"""The corpus pipeline: each stage on its own input, and all of them against a brute-force version."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from convrecall.llm import linededup, mixing, neardup, simhash

from .test_operators import ODD, SF, roots, slow_fingerprint


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_on_odd_rows(spark, docs):
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    for rows in (docs.unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            assert name == corpus_pipeline.STAGES[-1][0] or rows.columns == docs.columns
        rows.count()


def test_run_by_loop(spark, docs):
    kept = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert set(kept) == lettered  # clean documents stay
    db = duckdb.connect()
    import pandas as pd

    first = pd.DataFrame([r.asDict() for r in kept.values()])
    db.register("first", first)
    lines = db.execute(f"WITH RECURSIVE {linededup.line_sql('first')} SELECT doc_id, text FROM kept").df()
    second = first.drop(columns="text").merge(lines, on="doc_id")
    fps = [slow_fingerprint(t) for t in second["text"]]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    least = {}
    for k, root in enumerate(roots(len(fps), links)):
        least[root] = min(least.get(root, 10**9), second["doc_id"][k])
    third = second[second["doc_id"].isin(least.values())]
    db.register("third", third)
    fourth = db.execute(mixing.mixture_sql("third", mixing.SHARE, 1, "doc_id, text, lang, source")).df()
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < len(got) and Counter(got["doc_id"]) == Counter(fourth["doc_id"])
    import public_tokenizers as P
    import tiktoken

    from convrecall.llm import bpe

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = dict(zip(fourth["doc_id"], fourth["text"]))
    for r in got.itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(texts[r.doc_id])


def test_near_duplicates_beyond_simhash(spark):
    """Copies with Jaccard of 0.8 and more whose fingerprints are more than four bits apart are one; farther ones stay."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one three")]
    for g in range(8):
        base = [word() for _ in range(120)]
        for n in range(40 if g == 0 else 5):  # a group larger than FEW
            copy = list(base)
            for p in rnd.sample(range(120), n % 5):
                copy[p] = word()
            texts.append((100 + 50 * g + n, " ".join(copy)))
    runs = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    sets = [runs(t) for _, t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    fps = [slow_fingerprint(t) for _, t in texts]
    assert any((fps[a] ^ fps[b]).bit_count() > 4 for a, b in near)
    least = {}
    for k, root in enumerate(roots(len(texts), near)):
        least[root] = min(least.get(root, 10**9), texts[k][0])
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts] + [(None, "one two", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, rows, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter([*least.values(), None])


def test_near_duplicates_by_simhash_alone(spark):
    """Texts whose shingles agree in none of the MinHash bands are one by their fingerprints; an unlike text stays."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(3000)]
    runs = {xxhash.xxh64_intdigest(" ".join(base[i : i + 5]), 42): i for i in range(len(base) - 4)}
    hashes = np.array(sorted(runs), np.uint64)
    mixed = (hashes ^ neardup._XOR) * neardup._ODD
    mixed = (mixed ^ (mixed >> np.uint64(32))) * neardup._ODD
    least = [runs[int(hashes[j])] for j in mixed.argmin(1)[:: neardup.ROWS]]  # where each band's first minimum is
    own, bits = neardup.shingles(" ".join(base).encode()), 64
    while bits > 4:
        copy = list(base)
        for at in least:
            copy[at + rnd.randrange(5)] = word()
        other = neardup.shingles(" ".join(copy).encode())
        bits = ((simhash.majority(own) ^ simhash.majority(other)) & (1 << 64) - 1).bit_count()
    assert not set(neardup.bands(own)) & set(neardup.bands(other))
    both = len(set(own.tolist()) & set(other.tolist()))
    assert 5 * both >= 4 * (len(own) + len(other) - both)
    rows = [(7, " ".join(base)), (9, " ".join(copy)), (11, " ".join(word() for _ in range(3000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == Counter([7, 11])


def test_variants_in_the_third_stage_are_not_broadcast(spark, docs, monkeypatch):
    seen, real = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges, *ends: seen.append(edges) or real(edges, *ends))
    neardup.groups(docs).collect()
    seen[0].collect()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
