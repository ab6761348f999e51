"""The ten operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from convrecall.llm import ann, bpe, chat, common, langid, linededup, mixing, registry, simhash, suffix, urls, vecdedup

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "without an id but with words enough"), (4, "a " * 3000), (5, "\n\n"), (6, "12 34 ..."), (7, "été 中文 \U0001f600\x00")]


def docs_of(spark, rows):
    """Documents, with columns beside whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], DOC)
    return df.withColumns({c: F.lit("mine") for c in ("row", "line", "fp", "place", "content", "key", "n", "ids", "budget")})


def roots(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def varied(rnd, base, edits):
    s = list(base)
    for _ in range(edits):
        k, p = rnd.randrange(3) if len(s) > 1 else 0, rnd.randrange(len(s))
        if k == 0:
            s.insert(p, rnd.choice("abcé"))
        elif k == 1:
            s.pop(p)
        else:
            s[p] = rnd.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("null" if pd.isna(x) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)]
    got, again = ({r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), small=n).collect()} for n in (0, 1000))
    want = roots(361, edges)
    assert got == again == {n: want[n] for e in edges for n in e if e[0] != e[1]} | {n: want[n] for n in got}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_layouts_become_turns(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": {"x": 1}}),
        (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        (3, {"instruction": "a", "output": "b"}), (4, {"prompt": "a", "response": "b"}), (5, {"who": "knows"}), (6, [1]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(7, None), (8, "{")], "conv_id long, record string")
    got = {}
    for r in chat.canonical_records(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert all(got[i] == [(0, "user", "a"), (1, "assistant", "b")] for i in (1, 2, 3, 4))
    assert all(got[i] == [(None, None, None)] for i in (5, 6, 7, 8))
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


def test_template_is_reversible(spark):
    said = [None, "", "<|im_end|><|im_start|>assistant ok", "a\\n<\\|b\\\\", "line\nline\\", "<|<\\|<|"]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "o\nd<|d\\n", None) for t in said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("mine"))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.canonical(df.drop("segment")))).collect()}
    own = [(r or "", t or "") for c, _, r, t in rows if c == 1]
    for c in (1, None):
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()
    assert chat.digests(chat.formatted(chat.canonical(df.drop("segment").limit(0)))).count() == 0


# 2


@pytest.mark.parametrize(("edits", "few", "seed"), [(1, 2, 1), (1, 16, 2), (2, 4, 3)])
def test_near_lines_by_loop(spark, edits, few, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcé ") for _ in range(rnd.randrange(10, 40))) for _ in range(8)]
    lines = sorted({varied(rnd, b, rnd.choice([0, 1, 1, 2, 3])) for b in base for _ in range(15)})
    lines = [x for x in lines if len(x) >= 10]
    keyed = linededup._keyed(docs_of(spark, enumerate(lines)))
    pairs = {(r.a.doc_id, r.b.doc_id) for r in linededup.candidates(keyed, linededup._lines(keyed), edits, few).collect()}
    db = duckdb.connect()
    close = lambda a, b: db.execute("SELECT levenshtein(?, ?)", [lines[a], lines[b]]).fetchall()[0][0] <= edits
    want = [p for p in itertools.combinations(range(len(lines)), 2) if abs(len(lines[p[0]]) - len(lines[p[1]])) <= edits and close(*p)]
    assert roots(len(lines), [p for p in pairs if p in set(want)]) == roots(len(lines), want)


def test_banded_distance(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ab\U0001f600") for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(b, varied(rnd, b + "x", rnd.randrange(5))) for b in base], "a string, b string")
    for edits in (1, 2, 4):
        got = df.select((F.levenshtein("a", "b") <= edits).alias("want"), linededup.near(F.col("a"), F.col("b"), edits).alias("got"))
        assert got.where("want <> got").count() == 0


def test_near_on_long_lines(spark):
    """Time is in proportion to the line: a megabyte with an edit in its middle, and one whose halves differ."""
    long = "".join(random.Random(1).choices("abcdefgh é", k=1_000_000))
    rows = [(1, long), (2, long[:500_000] + "ß" + long[500_000:]), (3, long[:600_000] + long[:400_001][::-1])]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_lines_edge_cases(spark):
    rows = [*ODD, (8, "keep me as I am\nshort\nshort"), (9, "keep me as I an\nshort\n\nkeep me as I am"), (10, "x\nkeep me as I am" * 2)]
    got = linededup.dedup_lines(docs_of(spark, rows))
    assert got.columns == [*docs_of(spark, rows).columns, "n_lines", "n_removed"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text is None and (by[1].n_lines, by[1].n_removed) == (0, 0) and by[2].n_lines == 1
    assert by[8].text == "keep me as I am\nshort" and by[9].text == "" and by[9].n_removed == 3  # its blank line stays
    clash = docs_of(spark, rows).withColumn("n_lines", F.lit("mine")).withColumn("n_removed", F.lit("mine"))
    assert linededup.dedup_lines(clash).columns == got.columns
    assert linededup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


# 3


def test_budgets_flow_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 10.0), ("a", "en", "s2", 1000.0), ("a", "fr", "s3", 1000.0), ("b", "en", "s4", 50.0)], "domain string, lang string, source string, room double"
    )
    got = {r.source: r.budget for r in mixing.budgets(leaves, 400, {"domain": {"a": 0.5, "b": 0.5}}).collect()}
    # b is short by 150, which goes to a; within a, s1 is short and its language's other source makes up for it
    assert got == {"s1": 10, "s2": 165, "s3": 175, "s4": 50}


def test_mixture(spark):
    rows = [(i, "x" * 8) for i in range(400)]
    df = docs_of(spark, rows).drop("n").withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise("en"))
    got = mixing.mixed(df, F.lit("d"), F.lit(2), 0.75, {}, epochs=2, seed=3).groupBy("lang", "epoch").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k")).collect()
    found = {(r.lang, r.epoch): (r.n, r.k) for r in got}
    assert found[(None, 1)] == (100, 100) and found[(None, 2)][0] == 50 and found[("en", 1)][0] == 150 and all(n == k for n, k in found.values())
    assert mixing.mixed(df.limit(0), F.lit("d"), F.lit(2), 0.5, {}).count() == 0
    nulls = docs_of(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert mixing.mixed(nulls, mixing.domain_of(), mixing.tokens_of(), 1.0, {}).count() == len(ODD)


# 4 and 6


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "bucket", "tile")})


def random_vectors(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 5):
        x[i + 1] = x[i] + rng.normal(scale=rng.choice([0.02, 0.2, 0.33]), size=dim)
    x[7] = x[9]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


BAD = [(900, None), (901, [0.0] * 24), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] * 24), (None, [1.0] * 24)]


def test_neighbours(spark):
    x = random_vectors(1)
    rows = ann.usable(vectors_of(spark, [*((i, v.tolist()) for i, v in enumerate(x)), *BAD, (7, x[7].tolist())]), "vec_id", "embedding")
    got = {}
    for r in ann.search(rows.where("id % 20 = 0"), rows, k=10, block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    y = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:10]
        assert [v for v, _ in got[q]] == sorted((v for v, _ in got[q]), key=lambda v: (-s[v], v)) and len(got[q]) == 10
        assert all(c == pytest.approx(s[v], abs=1e-12) for v, c in got[q])
        hits += len({v for v, _ in got[q]} & set(order))
    assert hits >= 0.9 * 150
    split = {(r.query_id, r.rank, r.vec_id) for r in ann.search(rows.where("id % 20 = 0"), rows, k=10, mean=1, probes=24, block=8).collect()}
    assert len(split & {(q, i + 1, v) for q, found in got.items() for i, (v, _) in enumerate(found)}) >= 0.9 * 150  # several hashes, hot blocks
    few = rows.where("id < 4")
    assert ann.search(few, few, k=10).count() == 12  # fewer rows than asked for: all of them
    assert ann.search(rows.limit(0), rows.limit(0)).count() == 0


def test_double_vectors(spark):
    """Doubles stay doubles, large ones too; a hot vector is dealt out in blocks."""
    rows = [(i, [0.17, 0.0, 1.0]) for i in range(60)] + [(100, [1.0, 0.0, 0.0]), (101, [1e300, 1e300, 0.0]), (102, [-1e300, 0.0, 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = ann.usable(df, "vec_id", "embedding")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(own.where("id = 100"), own, k=70, block=8).collect()}
    assert len(got) == 62 and got[100, 1] == (101, 1e300) and got[100, 2] == (0, 0.17) and got[100, 62] == (102, -1e300)
    near = {r.id: r.n_links for r in vecdedup.near_vectors(df, "vec_id", "embedding").collect()}
    assert near[0] == 59 and near[101] == 0 and near[100] == 0


@pytest.mark.parametrize("tile", [16, 2048])
def test_near_vectors(spark, tile):
    x = random_vectors(2)
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), *BAD]
    got = {r.id: r for r in vecdedup.near_vectors(vectors_of(spark, rows), "vec_id", "embedding", 0.95, tile).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = np.argwhere(np.triu(y @ y.T >= 0.95, 1)).tolist()
    want, n = roots(300, links), Counter(i for p in links for i in p)
    assert len(links) > 20 and len(got) == len(rows)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (n[i], want[i], want[i] == i) for i in range(300))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905)) and got[None].kept
    assert vecdedup.near_vectors(vectors_of(spark, []), "vec_id", "embedding").count() == 0


def test_bucket_of_many_queries(spark, monkeypatch):
    """Many queries and few rows in a bucket: the queries are dealt out, and each finds what it would by itself."""
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(40)]
    own = ann.usable(vectors_of(spark, rows), "vec_id", "embedding")
    queries = spark.createDataFrame([(1000 + i, [1.0, 0.5 + i * 1e-4, 0.2, 0.1]) for i in range(300)], own.schema)
    shares, ranked = [], ann._ranked

    def seen(asked, filed, k):
        buckets = asked.select("axis", "part", "i", "j", F.explode("buckets").alias("bucket"))
        shares.append(buckets.groupBy("axis", "part", "i", "j", "bucket").count().agg(F.max("count")).first()[0])
        return ranked(asked, filed, k)

    monkeypatch.setattr(ann, "_ranked", seen)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(queries, own, k=5, tables=4, probes=8, block=64).collect()}
    assert shares[0] < 150 and len(got) == 1500
    x = np.float32([v for _, v in rows]).astype(float)
    for i in range(0, 300, 50):
        best = np.argsort(-(x @ np.float32([1.0, 0.5 + i * 1e-4, 0.2, 0.1]).astype(float)), kind="stable")[:5]
        assert [got[1000 + i, r] for r in range(1, 6)] == best.tolist()


def test_vectors_of_unlike_lengths(spark):
    """Each length by itself: no query meets, and no vector links, what has another length."""
    rows = [(i, ([1.0, 0.1 * (i // 3), 0.5, 0.0] * 2)[: 2 + i % 3]) for i in range(60)] + [(100, [1.0] * 9)]
    own = ann.usable(vectors_of(spark, rows), "vec_id", "embedding")
    queries = own.where("id in (0, 1, 100)").unionByName(spark.createDataFrame([(200, [1.0] * 7)], own.schema))
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(queries, own, k=30).collect()}
    vs = {i: np.float32(v).astype(float) for i, v in rows}
    want = {(q, i): vs[q] @ vs[i] for q in (0, 1, 100) for i in vs if i != q and len(vs[i]) == len(vs[q])}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    near = {r.id: (r.n_links, r.component_id) for r in vecdedup.near_vectors(vectors_of(spark, rows), "vec_id", "embedding").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vs.items()}
    links = [(i, j) for i in vs for j in vs if i < j and len(vs[i]) == len(vs[j]) and unit[i] @ unit[j] >= 0.95]
    n = Counter(i for p in links for i in p)
    want = roots(101, links)
    assert all(near[i] == (n[i], want[i]) for i in vs) and len(near) == 61


# 5


def test_urls(spark):
    link = lambda to: f'<HTML><link href="{to}" REL="canonical">'
    rows = [
        (1, "http://WWW.Example.com/en/x?q#f", ""), (2, "https://a.example.com/en/", ""), (3, "http://q.net/es/1", ""), (4, None, None), (5, "no scheme", ""),
        (6, "http://mirror.org/a", link("http://q.net/es/1")), (7, "http://mirror.org/b", '<meta http-equiv=refresh content="0; url=/a">'),
        (8, "http://other.org/c", link("http://b.com/ok")), (9, "http://both.org/d", link("http://q.net/fr/2") + link("//fine.com/")), (9, "http://q.net/fr/2", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("rule", F.lit("mine"))
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got[1, "www.example.com"] == ("/en/x", "www.example.com/en/", "allow") and got[2, "a.example.com"] == ("/en/", "example.com/en/", "block")
    assert got[3, "q.net"] == ("/es/1", "net/es/", "block") and got[4, ""] == ("", None, "allow") and got[5, ""] == ("", None, "allow")
    assert got[6, "mirror.org"] == ("/a", None, "block") and got[7, "mirror.org"] == ("/b", None, "block")  # by way of 6
    assert got[8, "other.org"][2] == "allow" and got[9, "both.org"] == ("/d", None, "allow") and got[9, "q.net"][2] == "block"
    assert urls.judged(df.limit(0)).count() == 0


# 7


def test_encodes_as_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["ab", " ", "\n", "é", "中", "\U0001f600", "'s", "12", "\x00", "<|endoftext|>", "▁"]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts)), (99, "long" * 5000)]
    got = bpe.round_trip(docs_of(spark, rows), bpe.load(path), P.PATTERN).collect()
    assert len(got) == len(rows)
    want = {(i, (t or "").encode(), tuple(other.encode_ordinary(t or ""))) for i, t in rows}
    assert {(r.doc_id, bytes(r.decoded), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want


# 8


def slow_fingerprint(text):
    words = (text or "").encode().translate(bytes([c + 32 if 65 <= c <= 90 else c for c in range(256)])).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_loop(spark):
    rnd = random.Random(4)
    base = ["Word " + " ".join(rnd.choice("abcdefghij") * 3 for _ in range(150)) for _ in range(6)]
    rows = [*ODD, *((100 + i, " ".join(w if rnd.random() > 0.01 else "zz" for w in rnd.choice(base).split(" "))) for i in range(60))]
    got = simhash.groups(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((i, slow_fingerprint(t)) for i, t in rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    least = {}
    for k, root in enumerate(roots(len(rows), links)):
        if rows[k][0] is not None:
            least[root] = min(least.get(root, 10**9), rows[k][0])
    want = Counter((rows[k][0], least.get(root)) for k, root in enumerate(roots(len(rows), links)))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert simhash.groups(docs_of(spark, rows).limit(0)).count() == 0


def test_simhash_without_ids(spark, monkeypatch):
    """Rows without a doc_id link what is near them: a chain over one, and groups of such rows alone."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", "fp"))
    rows = [(7, 0b0), (None, 0b1111), (3, 0b11111111), (None, 1 << 40), (None, (1 << 40) + 1), (9, 0b11 << 50), (9, 0b11 << 50)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(7, 3), (None, 3), (3, 3), (None, 3), (None, 3), (9, 3), (9, 3)])
    far = [(None, 0b11111 << 20), (None, 0b11111 << 20), (1, 0)]
    got = simhash.groups(spark.createDataFrame(far, "doc_id long, fp long")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, None), (None, None), (1, 1)])
    rnd = random.Random(9)
    fps = [rnd.getrandbits(62) for _ in range(5)]
    for _ in range(80):
        fps.append(rnd.choice(fps) ^ sum(1 << b for b in rnd.sample(range(62), rnd.randrange(1, 6))))
    ids = [None if rnd.random() < 0.33 else i for i in range(len(fps))]
    got = simhash.groups(spark.createDataFrame(list(zip(ids, fps)), "doc_id long, fp long")).collect()
    of = roots(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {root: min((ids[k] for k in range(len(fps)) if of[k] == root and ids[k] is not None), default=None) for root in of}
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == Counter((i, f, least[root]) for i, f, root in zip(ids, fps, of))


def test_every_link_once(spark):
    rnd = random.Random(6)
    fps = {0, -1, -(1 << 63)}
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(8):
            y = x
            for _ in range(rnd.randrange(7)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y - (1 << 64) if y >> 63 else y)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    want = {frozenset(p) for p in itertools.combinations(fps, 2) if ((p[0] ^ p[1]) % (1 << 64)).bit_count() <= 4}
    assert len(got) == len(want) and {frozenset((r.fa, r.fb)) for r in got} == want


def test_variants_are_not_broadcast(spark):
    """Fingerprints small enough to broadcast have variants that are not: 32 rows for each, on either side."""
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    found = simhash.links(fps)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


# 9


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.queries()["op9_language"](spark, SF).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count() and (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95 and got["score"].between(0, 1).all()


def test_language_spans_and_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    text = {lang: docs.where(F.col("lang") == lang).select("text").first()["text"][:400] for lang in ("en", "de")}
    got = langid.detect(docs_of(spark, [*ODD, (50, f"{text['en']} {text['de']}")]), model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) + 1 and all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 5, 6))
    assert [s.lang for s in by[50].spans] == ["en", "de"] and abs(by[50].spans[1].start - len(text["en"])) < 40
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.detect(docs, nothing).collect()} == {"und"}
    assert langid.detect(docs.limit(0), model).count() == 0


def plain_language(model, text):
    """Language and score by a plain dynamic program over the words, in double precision."""
    weights = np.frombuffer(model.weights, np.float32).reshape(-1, len(model.languages)).astype(float)
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    letters = [sum(c.isalpha() for c in w) for w in words]
    if not sum(letters):
        return "und", 0.0, 0.0, []
    every = []
    for w in words:
        b = f" {w} ".encode()
        own = sum(weights[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> 17] for i in range(len(b) - 2))
        may = np.array(model.scripts[langid.script(w)])
        every.append(np.where(may, own, -1e6) if may.any() and langid.script(w) >= 0 else np.zeros_like(own))
    best, back = np.array(every[0]), []
    for own in every[1:]:
        moved = best[:, None] - langid.SWITCH * (1 - np.eye(len(best)))  # from row to column
        back.append(moved.argmax(0))
        best = moved.max(0) + own
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    path.reverse()
    share = np.bincount(path, letters, len(best))
    return model.languages[int(share.argmax())], float(share.max() / share.sum()), float(best.max()), every


def test_language_by_plain_dynamic_program(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in langid.op9_language(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        lang, score, _, _ = plain_language(model, text)
        assert (got[doc_id].lang_pred, got[doc_id].score) == (lang, pytest.approx(score, abs=1e-3))


def test_mixed_spans_by_plain_dynamic_program(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    model = langid.train(docs)
    pool = [w for r in docs.collect() for w in r.text.lower().split()[:30]]
    rnd = random.Random(9)
    own = langid.Labeller(model)
    texts = [" ".join(rnd.choices(pool, k=rnd.randrange(1, 40))) for _ in range(80)]
    words = [langid.WORDS.findall(t) for t in texts]
    labels = own.viterbi([own.ids(w) for w in words], langid.SWITCH)
    for text, path in zip(texts, labels):
        _, _, best, every = plain_language(model, text)
        found = sum(own[k] for own, k in zip(every, path)) - langid.SWITCH * int((np.diff(path) != 0).sum())
        assert found == pytest.approx(best, abs=0.05)  # as good a path as the best one, whatever its ties


# 10


def slow_removal(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        yield len(t), sum(mask), sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask)), bytes(c for c, m in zip(t, mask) if not m)


@pytest.mark.parametrize(("length", "key", "group"), [(40, 20, 1000), (40, 20, 1), (60, 10, 1000)])
def test_repeats_by_loop(spark, length, key, group):
    rnd = random.Random(length + group)
    shared = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(20, 200))) for _ in range(8)]
    texts = ["".join(rnd.choice([*shared, "x" * rnd.randrange(70), "".join(rnd.choice("abcdef") for _ in range(50))]) for _ in range(rnd.randrange(6))) for _ in range(60)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts)), (100, texts[0]), (101, texts[2])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(docs_of(spark, rows), length, key, group).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, slow_removal([(t or "").encode() for _, t in rows], length)))
    assert got == want
    assert suffix.remove_repeats(docs_of(spark, rows).limit(0), length, key).count() == 0


def test_many_rows_alike(spark):
    """Thousands of rows that are alike in doc_id and text take a result each, in time in proportion to them."""
    text = "".join(random.Random(3).choices("abcdefgh ", k=4000))
    one = spark.createDataFrame([(None, text), (1, text[1000:1600] + "x" * 300), (2, "y" * 399)], DOC.rpartition(",")[0])
    rows = one.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id").isNull(), 10_000).otherwise(1))))
    got = {(r.doc_id, r.n_removed, r.n_spans, r.n) for r in suffix.remove_repeats(rows).groupBy("doc_id", "n_removed", "n_spans").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 4000, 1, 10_000), (1, 600, 1, 1), (2, 0, 0, 1)}


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 128)
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"ab") for _ in range(3000))
    small = dict(suffix.Sampler(60, 20).anchors([b"short", text]))
    monkeypatch.setattr(suffix, "CHUNK", 1 << 16)
    assert small == dict(suffix.Sampler(60, 20).anchors([b"short", text]))


def test_orders():
    rnd = random.Random(9)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(3))) + rnd.choice([b"", b"c" * 60]) + bytes(rnd.choice(b"ab") for _ in range(5)) for _ in range(400)]
    for order in (suffix.deep_shallow_order(strings), suffix.blind_order(strings, list(range(400)))):
        assert sorted(order) == list(range(400)) and [strings[i] for i in order] == sorted(strings)


def test_labels_beyond_the_bound(spark):
    """The labels of most distinct texts are learned, and the others' documents get one of them."""
    rows = [(i, f"{'alpha beta gamma' if i % 2 else 'eins zwei drei'} w{chr(97 + i % 26)}", "ab"[i % 2]) for i in range(40)] + [(50, "uno due tre", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = langid.train(docs, most=2), langid.train(docs)
    assert few.languages == ("a", "b") and all_.languages == ("a", "b", "c")
    assert {r.lang_pred for r in langid.detect(docs, few).collect()} == {"a", "b"} and {r.lang_pred for r in langid.detect(docs, all_).collect()} == {"a", "b", "c"}


def test_languages_of_few_hot_texts(spark):
    """A language of few texts is learned whatever their hashes, and copies teach once."""
    rows = [(f"wort{c} satz{c} und", f"l{c}") for c in "abcdefghijkl" for _ in range(400)]
    df = lambda r: spark.createDataFrame(r, "text string, lang string")
    many, once = langid.train(df(rows), sample=1), langid.train(df(sorted(set(rows))), sample=1)
    assert many.languages == tuple(f"l{c}" for c in "abcdefghijkl")
    assert many == once
