"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from convrecall.functions import text as T
from convrecall.operators import coref, curate, evaluation, facts as M, graph, keyword, qrels, rerank, vectors
from convrecall.operators.kept_index import KeptIndex
from convrecall.plans import inputs as I
from convrecall.sources import conversations as S
from convrecall.sources.keyed import KeyedTable
from convrecall.sources.shared import new_folder
from convrecall.streaming import memory as R
from convrecall.streaming.eventtime import EventTime

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_passages(spark, sf_dir)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _toks(c: str) -> str:
    return f"[lower(x) for x in regexp_extract_all({c}, '[A-Za-z0-9]+')]"


def _jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))::DOUBLE)"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


# text functions


@query(f"""SELECT conv_id, turn, {_norm('text')} AS norm, lower({_norm("role || '  ' || text")}) AS entity,
  trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS squashed, regexp_replace(lower(trim(text, ' ' || chr(10))), '[ \\t\\r\\n.!?、。！？…]+$', '') AS evidence
  FROM conversations""")
def text_normal_forms(spark, sf_dir):
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.norm_text("text").alias("norm"), T.norm_entity(F.concat("role", F.lit("  "), "text")).alias("entity"),
        T.squash("text").alias("squashed"), T.canon_evidence("text").alias("evidence"),
    )


@query(f"""SELECT conv_id, turn, array_to_string([lower(x) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') if lower(x) NOT IN ({_STOP})], ' ') AS keywords,
  array_to_string({_toks("coalesce(text, '')")}, ' ') AS words FROM conversations""")
def text_tokens(spark, sf_dir):
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(T.keyword_tokens("text"), " ").alias("keywords"), F.array_join(T.graph_tokens("text"), " ").alias("words")
    )


@query(f"""WITH {I.TURNS}, u AS (SELECT conv_id, turn_id, {_norm('text')} AS text FROM turns WHERE lower(role) = 'user')
  SELECT conv_id, turn_id, text FROM u WHERE text <> '' AND NOT (contains(text, '?') OR regexp_matches(text, '^\\s*(what|who|whom|whose|which|where|when|why|how)\\b', 'i'))""")
def user_turn_filter(spark, sf_dir):
    return keyword.user_turns(I.turns(spark, sf_dir)).select("conv_id", "turn_id", "text")


@query("""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(event_type || ' - Is_' || user_id || '!'), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS snake,
  CASE event_id % 4 WHEN 0 THEN 'lives_in' WHEN 1 THEN 'name' WHEN 2 THEN 'likes' ELSE event_type END AS canon, sha1(concat_ws('::', event_id, event_type, '')) AS stable FROM events""")
def predicate_names(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "Reside in").when(F.col("event_id") % 4 == 1, "is_named").when(F.col("event_id") % 4 == 2, " enjoy").otherwise(F.col("event_type"))
    snake = T.snake_like(F.concat("event_type", F.lit(" - Is_"), F.col("user_id").cast("string"), F.lit("!")))
    return I.table(spark, sf_dir, "events").select("event_id", snake.alias("snake"), T.canon_predicate(raw).alias("canon"), T.stable_id("event_id", "event_type", F.lit(None)).alias("stable"))


@query("""SELECT event_id, round(pow(0.5, greatest(0, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01')) / 604800.0), 9) AS weight FROM events""")
def recency_weights(spark, sf_dir):
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return I.table(spark, sf_dir, "events").select("event_id", F.round(T.half_life_weight(age), 9).alias("weight"))


def _replies(spark, sf_dir):
    head = F.col("event_id") % 3
    q = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    plain = q('[{"subject": "me", "predicate": "', F.col("event_type"), '", "object": "', F.col("user_id"), '", "source_span": "s"}]')
    fenced = q('Sure:\n```json\n[{"subject": " I ", "predicate": "Has Name", "object": "n', F.col("user_id"), '", "confidence": 0.5, "source_span": "x  y"}]\n```')
    reply = F.when(head == 0, plain).when(head == 1, fenced).otherwise("none [broken")
    return I.table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn_id"), reply.alias("reply"))


@query("""SELECT user_id AS conv_id, event_id AS turn_id, 0 AS fact_idx, CASE event_id % 3 WHEN 0 THEN 'me' ELSE 'I' END AS subject,
  CASE event_id % 3 WHEN 0 THEN event_type ELSE 'name' END AS predicate, CASE event_id % 3 WHEN 0 THEN '' ELSE 'n' END || user_id AS object,
  CASE event_id % 3 WHEN 0 THEN 0.85::DOUBLE ELSE 0.5 END AS confidence, CASE event_id % 3 WHEN 0 THEN 's' ELSE 'x  y' END AS evidence FROM events WHERE event_id % 3 < 2""")
def replies_to_facts(spark, sf_dir):
    return M.parse_replies_plain(_replies(spark, sf_dir))


@query("""SELECT user_id AS conv_id, event_id AS turn_id, 0 AS fact_idx, CASE event_id % 3 WHEN 0 THEN 'me' ELSE 'I' END AS subject,
  CASE event_id % 3 WHEN 0 THEN event_type ELSE 'has_name' END AS predicate, CASE event_id % 3 WHEN 0 THEN '' ELSE 'n' END || user_id AS object,
  CASE event_id % 3 WHEN 0 THEN 0.85::DOUBLE ELSE 0.5 END AS confidence, CASE event_id % 3 WHEN 0 THEN 's' ELSE 'x y' END AS evidence FROM events WHERE event_id % 3 < 2""")
def replies_to_graph_facts(spark, sf_dir):
    return M.parse_replies_graph(_replies(spark, sf_dir))


@query("""SELECT user_id AS conv_id, event_id AS turn_id, 0 AS fact_idx, 'u' || user_id AS subject, 'works_at' AS predicate, event_type AS object, 0.85::DOUBLE AS confidence,
  'f' || event_id AS fact_id, CAST(NULL AS VARCHAR) AS created_at, 'k=' || json_extract_string(props, '$.k') AS meta FROM events WHERE event_id % 5 <> 0""")
def payload_to_facts(spark, sf_dir):
    head = F.concat(F.lit('[{"subject": "u'), F.col("user_id").cast("string"), F.lit('", "predicate": "employed at", "object": "'), "event_type", F.lit('", "fact_id": "f'),
                    F.col("event_id").cast("string"), F.lit('", "k": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    payload = F.when(F.col("event_id") % 5 == 0, F.lit('["no object"]')).otherwise(F.concat(head, F.lit("]")))
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn_id"), payload.alias("payload"))
    return M.coerce_payload(rows).withColumn("meta", F.concat(F.lit("k="), F.col("meta")["k"]))


@query("""SELECT user_id AS conv_id, event_id, i AS item, CASE WHEN i = 2 THEN value WHEN i = 1 THEN 1.5 ELSE 0 END AS score FROM events, (SELECT unnest([1, 2, 3]) AS i)""")
def reply_rank_scores(spark, sf_dir):
    reply = F.concat(F.lit('ok {"scores": [{"index": 2, "score": '), F.col("value").cast("string"), F.lit('}, {"index": 1, "score": 1.5}]} bye'))
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), "event_id", F.posexplode(T.rank_scores(reply, F.lit(3))).alias("at", "score"))
    return rows.select("conv_id", "event_id", (F.col("at") + 1).alias("item"), "score")


# keyword memory


def _bm25_sql(k: int, docs: str = "docs", probes: str = "probes") -> str:
    return f"""tok AS (SELECT scope, doc, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM {docs}),
post AS (SELECT scope, doc, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY ALL),
len AS (SELECT d.scope, d.doc, coalesce(sum(p.tf), 0) AS length FROM {docs} d LEFT JOIN post p USING (scope, doc) GROUP BY ALL),
stats AS (SELECT scope, count(*) AS n, avg(length) AS avgdl FROM len GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT qid, scope, term, count(*) AS qtf FROM (SELECT qid, scope, lower(unnest(regexp_extract_all(query, '[A-Za-z0-9_]+'))) AS term FROM {probes}) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
scored AS (
  SELECT a.qid, a.scope, p.doc, sum(a.qtf * ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.length / CASE WHEN s.avgdl > 0 THEN s.avgdl ELSE 1 END))) AS score
  FROM asked a JOIN df d USING (scope, term) JOIN stats s USING (scope) JOIN post p USING (scope, term) JOIN len l ON l.scope = a.scope AND l.doc = p.doc GROUP BY ALL
), found AS (
  SELECT * FROM (
    SELECT s.qid, s.scope, s.doc, x.text, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 9) DESC, s.doc) AS rank
    FROM scored s JOIN {docs} x USING (scope, doc) JOIN {probes} q USING (qid) WHERE q.query <> '' AND q.query <> x.text
  ) WHERE rank <= {k}
)"""


@query(f"""WITH {I.CORPUS}, {I.PASSAGES}, {_bm25_sql(5)}
SELECT f.qid, CAST(f.rank AS INTEGER) AS rank, f.doc, round(f.score, 4) AS score, CAST(contains(lower(f.text), lower(p.query)) AS INTEGER) AS rel FROM found f JOIN probes p USING (qid)""")
def bm25_passages(spark, sf_dir):
    """The flagship: passages searched in the corpus, and whether what is found holds them."""
    probes = I.passages(spark, sf_dir)
    found = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 5)
    run = found.select("qid", "rank", "doc", "score", "text", F.lit("").alias("object"))
    return evaluation.judge(run, probes).select("qid", "rank", "doc", "score", "rel")


def _chats(spark, sf_dir):
    """What users say in each conversation, and all of its keywords as a query of the conversation."""
    docs = keyword.dedup_turns(keyword.user_turns(I.turns(spark, sf_dir))).select(F.col("conv_id").alias("scope"), F.col("turn_id").alias("doc"), "text")
    asked = F.array_join(T.keyword_tokens("text"), " ")
    return docs, docs.select(F.concat_ws(":", F.col("scope").cast("string"), F.col("doc").cast("string")).alias("qid"), "scope", asked.alias("query"))


_CHATS = f"""{I.TURNS}, u AS (
  SELECT conv_id AS scope, turn_id AS doc, {_norm('text')} AS text FROM turns WHERE lower(role) = 'user'
), docs AS (
  SELECT scope, min(doc) AS doc, text FROM u WHERE text <> '' AND NOT (contains(text, '?') OR regexp_matches(text, '^\\s*(what|who|whom|whose|which|where|when|why|how)\\b', 'i')) GROUP BY scope, text
), probes AS (
  SELECT scope || ':' || doc AS qid, scope, array_to_string([lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+') if lower(x) NOT IN ({_STOP})], ' ') AS query FROM docs
)"""


@query(f"WITH {_CHATS}, {_bm25_sql(3)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc, text, round(score, 4) AS score FROM found")
def bm25_chats(spark, sf_dir):
    docs, probes = _chats(spark, sf_dir)
    return keyword.bm25_retrieve(probes, docs, 3).select("qid", "rank", "doc", "text", "score")


@query(f"WITH {I.CORPUS}, {I.PASSAGES}, {_bm25_sql(1)} SELECT d.term, d.df, s.n, round(s.avgdl, 6) AS avgdl FROM df d JOIN stats s USING (scope)")
def bm25_term_statistics(spark, sf_dir):
    index = keyword.bm25_index(I.corpus(spark, sf_dir))
    return index.terms.join(index.stats, "scope").select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {I.TURNS}, twice AS (SELECT * FROM turns UNION ALL SELECT conv_id, turn_id + 100, role, text FROM turns),
u AS (SELECT conv_id, turn_id, {_norm('text')} AS text FROM twice WHERE lower(role) = 'user') SELECT conv_id, min(turn_id) AS turn_id, text FROM u
WHERE text <> '' AND NOT (contains(text, '?') OR regexp_matches(text, '^\\s*(what|who|whom|whose|which|where|when|why|how)\\b', 'i')) GROUP BY conv_id, text""")
def turn_dedup(spark, sf_dir):
    rows = I.turns(spark, sf_dir)
    twice = rows.unionByName(rows.withColumn("turn_id", F.col("turn_id") + 100))
    return keyword.dedup_turns(keyword.user_turns(twice)).select("conv_id", "turn_id", "text")


# evaluation


def _evaluated(spark, sf_dir):
    probes = I.passages(spark, sf_dir)
    found = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 5)
    run = found.select("qid", "rank", F.lit("chunk").alias("type"), F.col("doc").cast("string").alias("id"), "text", *[F.lit("").alias(c) for c in ("subject", "predicate", "object")], "score")
    return evaluation.evaluate(run, probes, 5)


_EVAL = f"""{I.CORPUS}, {I.PASSAGES}, {_bm25_sql(5)},
judged AS (SELECT f.qid, f.rank, f.text, CAST(contains(lower(f.text), lower(p.query)) AS INTEGER) AS rel FROM found f JOIN probes p USING (qid)),
upto AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS sofar FROM judged),
sums AS (SELECT qid, sum(rel) AS hits, sum(rel * sofar / rank::DOUBLE) AS ap, min(rank) FILTER (WHERE rel = 1) AS rank, sum(rel / log2(rank + 1)) AS dcg, count(*) AS retrieved,
  max(text) FILTER (WHERE rank = 1) AS top FROM upto GROUP BY qid),
ev AS (
  SELECT p.qid, p.scenario, p.difficulty, CAST(lower(coalesce(s.top, '')) = lower(p.query) AS INTEGER) AS em, CAST(coalesce(s.hits, 0) AS BIGINT) AS hits, coalesce(s.hits, 0) / 5.0::DOUBLE AS precision,
    CASE WHEN s.hits > 0 THEN 1.0::DOUBLE ELSE 0 END AS recall, CASE WHEN s.hits > 0 THEN 2 * (s.hits / 5.0::DOUBLE) / (s.hits / 5.0::DOUBLE + 1) ELSE 0 END AS f1,
    CASE WHEN s.hits > 0 THEN s.ap / s.hits ELSE 0 END AS ap, coalesce(1.0::DOUBLE / s.rank, 0) AS rr,
    CASE WHEN s.hits > 0 THEN s.dcg / list_sum([1 / log2(i + 1) for i in range(1, CAST(s.hits AS BIGINT) + 1)]) ELSE 0 END AS ndcg,
    CAST(s.rank IS NOT NULL AS INTEGER) AS hit, CAST(s.rank AS INTEGER) AS rank, coalesce(s.retrieved, 0) AS retrieved
  FROM probes p LEFT JOIN sums s USING (qid)
)"""
_COLS = ("ap", "f1", "ndcg", "precision", "recall", "rr")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _COLS)


@query(f"WITH {_EVAL} SELECT qid, scenario, difficulty, em, hits, {_ROUNDED}, hit, rank, retrieved FROM ev")
def evaluation_per_query(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    return rows.select("qid", "scenario", "difficulty", "em", "hits", *[F.round(c, 6).alias(c) for c in _COLS], "hit", "rank", "retrieved")


def _answered(probes):
    """Passages as questions with an answer, their longest word; the passage is the quote."""
    return probes.withColumn("expected", I.longest_word("query"))


_HELD = "(want <> '' AND contains(lower({d}.text), want)) OR (query <> '' AND contains(lower({d}.text), lower(query)))"
_ASKED = f"{I.CORPUS}, {I.PASSAGES}, wants AS (SELECT qid, scenario, difficulty, query, {I.longest_word_sql('query')} AS want FROM probes)"


@query(f"WITH {_ASKED} SELECT DISTINCT qid, doc FROM wants JOIN docs d ON {_HELD.format(d='d')}")
def qrels_corpus(spark, sf_dir):
    """Every document that holds a passage's answer or the passage."""
    return qrels.corpus_qrels(_answered(I.passages(spark, sf_dir)), I.corpus(spark, sf_dir))


@query(f"""WITH {_ASKED}, {_bm25_sql(5)}, total AS (SELECT qid, count(DISTINCT doc) AS n_rel FROM wants JOIN docs d ON {_HELD.format(d='d')} GROUP BY qid),
judged AS (SELECT f.qid, f.rank, CAST({_HELD.format(d='f')} AS INTEGER) AS rel FROM found f JOIN wants USING (qid)), upto AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS sofar FROM judged),
sums AS (SELECT qid, sum(rel) AS hits, sum(rel * sofar / rank::DOUBLE) AS ap, min(rank) FILTER (WHERE rel = 1) AS rank, sum(rel / log2(rank + 1)) AS dcg FROM upto GROUP BY qid),
whole AS (SELECT a.qid, a.difficulty, CAST(coalesce(hits, 0) AS BIGINT) AS hits, coalesce(n_rel, 0) AS n_rel, ap, dcg, rank FROM wants a LEFT JOIN total USING (qid) LEFT JOIN sums USING (qid))
SELECT qid, difficulty, hits, round(hits / 5.0::DOUBLE, 6) AS precision, round(CASE WHEN n_rel > 0 THEN hits / n_rel::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN hits > 0 THEN 2 * (hits / 5.0::DOUBLE) * (hits / n_rel::DOUBLE) / (hits / 5.0::DOUBLE + hits / n_rel::DOUBLE) ELSE 0 END, 6) AS f1,
  round(CASE WHEN n_rel > 0 THEN coalesce(ap, 0) / n_rel ELSE 0 END, 6) AS ap, round(coalesce(1.0::DOUBLE / rank, 0), 6) AS rr,
  round(CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(n_rel, 5) + 1)]) ELSE 0 END, 6) AS ndcg, CAST(rank AS INTEGER) AS rank FROM whole""")
def evaluation_corpus(spark, sf_dir):
    """The same passages judged against all that is relevant in the corpus, so that recall is what was found of it."""
    docs, probes = I.corpus(spark, sf_dir), _answered(I.passages(spark, sf_dir))
    found = keyword.bm25_retrieve(probes, docs, 5)
    run = found.select("qid", "rank", F.lit("chunk").alias("type"), F.col("doc").cast("string").alias("id"), "text", *[F.lit("").alias(c) for c in ("subject", "predicate", "object")], "score")
    rows = evaluation.evaluate(run, probes, 5, qrels.totals(qrels.corpus_qrels(probes, docs)))
    return rows.select("qid", "difficulty", "hits", *[F.round(c, 6).alias(c) for c in _COLS], "rank")


_MEANS = ", ".join(f"round(avg({c}), 6) AS {n}" for c, n in evaluation.MEANS.items())


def _means(df, *keys):
    return df.select(*keys, "count", *[F.round(n, 6).alias(n) for n in evaluation.MEANS.values()])


@query(f"WITH {_EVAL} SELECT count(*) AS count, {_MEANS} FROM ev")
def evaluation_macro(spark, sf_dir):
    return _means(evaluation.macro(_evaluated(spark, sf_dir)))


@query(f"WITH {_EVAL} SELECT scenario, difficulty, count(*) AS count, {_MEANS} FROM ev GROUP BY ROLLUP (scenario, difficulty)")
def evaluation_breakdown(spark, sf_dir):
    return _means(evaluation.breakdown(_evaluated(spark, sf_dir), "scenario", "difficulty"), "scenario", "difficulty")


_RERANKED = f"""words AS (SELECT f.*, [x for x in string_split(lower(p.query), ' ') if x <> ''] AS a, [x for x in string_split(lower(f.text), ' ') if x <> ''] AS b FROM found f JOIN probes p USING (qid)),
again AS (SELECT qid, text, row_number() OVER (PARTITION BY qid ORDER BY round(80 * round(score, 4) + 20 * {_jac('a', 'b')}, 9) DESC, doc) AS rank FROM words),
both AS (SELECT 'keyword' AS system, qid, rank, text FROM found UNION ALL SELECT 'keyword reranked', qid, rank, text FROM again)"""


@query(f"""WITH {I.CORPUS}, {I.PASSAGES}, {_bm25_sql(5)}, {_RERANKED.replace("both AS", "runs AS")}
SELECT s.system, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr FROM (
  SELECT k.system, p.qid, CAST(coalesce(bool_or(contains(lower(r.text), lower(p.query))), false) AS INTEGER) AS hit,
    coalesce(1.0::DOUBLE / min(r.rank) FILTER (WHERE contains(lower(r.text), lower(p.query))), 0) AS rr
  FROM probes p CROSS JOIN (SELECT unnest(['keyword', 'keyword reranked']) AS system) k LEFT JOIN runs r ON r.qid = p.qid AND r.system = k.system GROUP BY ALL
) s GROUP BY s.system""")
def evaluation_of_systems(spark, sf_dir):
    """The same probes through two systems, side by side."""
    probes = I.passages(spark, sf_dir)
    found = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 5)
    again = rerank.lexical_rerank(found.join(probes.select("qid", "query"), "qid"))
    again = keyword.top_k(again.drop("rank", "score"), 5, "doc", score="rerank").withColumnRenamed("rerank", "score")
    scored = None
    for name, rows in (("keyword", found), ("keyword reranked", again)):
        run = rerank.envelope(rows.select("qid", "rank", "score", "text", F.lit("chunk").alias("type"), F.col("doc").alias("id")), name)
        one = evaluation.evaluate(run, probes, 5).withColumn("system", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    return scored.groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"""WITH {I.CORPUS}, {I.PASSAGES}, {_bm25_sql(1)} SELECT f.qid, contains(lower(f.text), lower(p.query)) AS contained, false AS object_equal,
trim(regexp_replace(lower(f.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(p.query), '[^a-z0-9]+', ' ', 'g')) AS squashed_equal FROM found f JOIN probes p USING (qid)""")
def evaluation_quick_checks(spark, sf_dir):
    probes = I.passages(spark, sf_dir)
    tops = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 1).select("qid", "text", F.lit(None).cast("string").alias("object")).join(probes.select("qid", "expected"), "qid")
    return evaluation.quick_checks(tops).select("qid", "contained", "object_equal", "squashed_equal")


@query(f"""WITH {_CHATS}, {_bm25_sql(3)} SELECT qid, CAST(rank AS INTEGER) AS rank, 'keyword' AS system, round(score, 6) AS score, 'chunk' AS type, CAST(doc AS VARCHAR) AS id, text, CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS predicate,
CAST(NULL AS VARCHAR) AS object, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS created_at FROM (SELECT * REPLACE (round(score, 4) AS score) FROM found)""")
def result_envelope(spark, sf_dir):
    docs, probes = _chats(spark, sf_dir)
    rows = keyword.bm25_retrieve(probes, docs, 3).select("qid", "rank", "score", "text", F.lit("chunk").alias("type"), F.col("doc").alias("id"))
    return rerank.envelope(rows, "keyword").withColumn("score", F.round("score", 6)).drop("scores")


@query(f"""WITH {_CHATS}, {_bm25_sql(3)}, w AS (SELECT f.*, p.query, [x for x in string_split(lower(p.query), ' ') if x <> ''] AS a, [x for x in string_split(lower(f.text), ' ') if x <> ''] AS b FROM found f JOIN probes p USING (qid))
SELECT qid, doc, round(80 * round(score, 4) + 20 * {_jac('a', 'b')}, 6) AS rerank FROM w""")
def rerank_lexical(spark, sf_dir):
    docs, probes = _chats(spark, sf_dir)
    rows = keyword.bm25_retrieve(probes, docs, 3).join(probes.select("qid", "query"), "qid")
    return rerank.lexical_rerank(rows).select("qid", "doc", F.round("rerank", 6).alias("rerank"))


@query(f"""WITH {_CHATS}, {_bm25_sql(3)}, n AS (SELECT qid, count(*) AS n FROM found GROUP BY qid) SELECT qid, CAST(rank AS INTEGER) AS rank, doc, CASE rank WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 20.5 ELSE 0 END AS rerank FROM found""")
def rerank_by_replies(spark, sf_dir):
    docs, probes = _chats(spark, sf_dir)
    rows = keyword.bm25_retrieve(probes, docs, 3).join(probes.select("qid", "query"), "qid")
    replies = rerank.rank_prompts(rows).select("qid", "n", F.lit('{"scores": [{"index": 1, "score": 10}, {"index": 2, "score": 20.5}]}').alias("reply"))
    return rerank.model_rerank(rows, replies).select("qid", "rank", "doc", "rerank")


# facts and memory state


@query(f"""WITH {I.FACTS} SELECT predicate, count(*) FILTER (WHERE confidence BETWEEN 0 AND 1) AS valid, count(*) FILTER (WHERE NOT confidence BETWEEN 0 AND 1) AS rejected FROM facts GROUP BY 1""")
def fact_validation(spark, sf_dir):
    good, bad = M.split_valid(I.facts(spark, sf_dir))
    both = good.withColumn("ok", F.lit(1)).unionByName(bad.withColumn("ok", F.lit(0)))
    return both.groupBy("predicate").agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("rejected"))


@query(f"""WITH {I.FACTS} SELECT conv_id, turn_id, coalesce(last_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), subject) AS subject, predicate FROM facts""")
def alias_forward(spark, sf_dir):
    return M.forward_alias(I.facts(spark, sf_dir)).select("conv_id", "turn_id", "subject", "predicate")


_RETRO = f"""{I.FACTS}, named AS (
  SELECT * REPLACE (coalesce(
    last_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), subject) AS subject)
  FROM facts
)"""


@query(f"WITH {_RETRO} SELECT conv_id, turn_id, subject, predicate, object FROM named")
def alias_retroactive(spark, sf_dir):
    return M.retroactive_alias(I.facts(spark, sf_dir)).select("conv_id", "turn_id", "subject", "predicate", "object")


def _cased(facts):
    """Facts with names in two casings, some of them blank."""
    name = F.when(F.col("ingest_seq") % 5 == 0, F.lit("  ")).when(F.col("ingest_seq") % 2 == 0, F.upper("object")).otherwise(F.col("object"))
    return facts.withColumn("object", F.when(F.col("predicate") == "name", name).otherwise(F.regexp_replace("object", "[0-9]+", "")))


@query(f"""WITH {I.FACTS}, cased AS (
  SELECT * REPLACE (CASE WHEN predicate <> 'name' THEN regexp_replace(object, '[0-9]+', '', 'g') WHEN ingest_seq % 5 = 0 THEN '  ' WHEN ingest_seq % 2 = 0 THEN upper(object) ELSE object END AS object) FROM facts
), heard AS (
  SELECT *, list(trim(object)) FILTER (WHERE predicate = 'name' AND trim(object) <> '') OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names,
    list(trim(object)) FILTER (WHERE predicate = 'name' AND trim(object) <> '') OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM cased
) SELECT conv_id, turn_id, coalesce(list_reduce(names, lambda a, b: CASE WHEN lower(a) = lower(b) THEN a ELSE b END), every[1], subject) AS subject, predicate, object FROM heard""")
def alias_casing(spark, sf_dir):
    """Names that come again in another casing leave the first spelling; blank ones are no names."""
    return M.retroactive_alias(_cased(I.facts(spark, sf_dir))).select("conv_id", "turn_id", "subject", "predicate", "object")


_SLOTS = f"""{I.FACTS}, states AS (
  SELECT *, lead(fact_id) OVER w IS NULL AS active, lag(fact_id) OVER w AS supersedes, lead(turn_id) OVER w AS valid_to
  FROM facts WINDOW w AS (PARTITION BY conv_id, lower(subject), lower(predicate) ORDER BY turn_id, fact_idx)
)"""


@query(f"WITH {_SLOTS} SELECT conv_id, turn_id, fact_id, predicate, active, supersedes, valid_to FROM states")
def slots_by_conversation(spark, sf_dir):
    return M.slot_states(I.facts(spark, sf_dir)).select("conv_id", "turn_id", "fact_id", "predicate", "active", "supersedes", "valid_to")


@query(f"""WITH {I.FACTS} SELECT conv_id, fact_id, predicate, lead(fact_id) OVER w IS NULL AS active, lag(fact_id) OVER w AS supersedes
FROM facts WINDOW w AS (PARTITION BY lower(subject), lower(predicate) ORDER BY ingest_seq, turn_id, fact_idx)""")
def slots_global(spark, sf_dir):
    return M.slot_states(I.facts(spark, sf_dir), "global").select("conv_id", "fact_id", "predicate", "active", "supersedes")


@query(f"WITH {I.FACTS} SELECT predicate, arg_max(fact_id, ingest_seq) AS fact_id, arg_max(object, ingest_seq) AS object FROM facts GROUP BY predicate")
def slots_global_latest(spark, sf_dir):
    return M.latest_global(I.facts(spark, sf_dir)).select("predicate", "fact_id", "object")


@query(f"""WITH {_SLOTS}, moments AS (SELECT conv_id, CAST(max(turn_id) // 2 AS INTEGER) AS at FROM facts GROUP BY conv_id)
SELECT m.conv_id, m.at, s.predicate, s.object FROM moments m JOIN states s ON s.conv_id = m.conv_id AND s.turn_id <= m.at AND (s.valid_to IS NULL OR s.valid_to > m.at)""")
def facts_as_of(spark, sf_dir):
    facts = I.facts(spark, sf_dir)
    moments = facts.groupBy(F.col("conv_id").alias("conv_id")).agg(F.expr("cast(max(turn_id) div 2 as int)").alias("at")).withColumn("qid", F.col("conv_id"))
    return M.as_of(M.slot_states(facts), moments).select(F.col("qid").alias("conv_id"), "at", "predicate", "object")


@query(f"SELECT conv_id, entity, max(turn_id) AS last_turn FROM (WITH {I.FACTS} SELECT conv_id, lower(unnest([subject, object])) AS entity, turn_id FROM facts) GROUP BY ALL")
def entity_timeline(spark, sf_dir):
    return M.entity_timeline(I.facts(spark, sf_dir))


@query(f"WITH {I.FACTS} SELECT 'chunk_' || substr(sha256(fact_id), 1, 12) AS chunk_id, concat_ws(' | ', subject, predicate, object) AS text, conv_id, turn_id FROM facts")
def fact_chunks(spark, sf_dir):
    return M.chunks(I.facts(spark, sf_dir)).where(F.col("meta")["type"] == "fact").select("chunk_id", "text", "conv_id", "turn_id")


@query("""SELECT DISTINCT source, subject, predicate, object, confidence, active, supersedes, created_at,
  'fact_' || substr(sha256(concat_ws(chr(31), source, subject, predicate, object)), 1, 12) AS fact_id, valid FROM (
  SELECT 'user ' || user_id AS source, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'user ' || user_id END AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object,
    CASE WHEN event_id % 3 = 0 THEN 0.85 ELSE value / 100 END AS confidence, true AS active, CAST(NULL AS VARCHAR) AS supersedes, CAST(ts AS VARCHAR) AS created_at,
    event_id % 7 <> 0 AND coalesce(json_extract_string(props, '$.k'), '') <> '' AND CASE WHEN event_id % 3 = 0 THEN 0.85 ELSE value / 100 END BETWEEN 0 AND 1 AS valid FROM events)""")
def made_facts(spark, sf_dir):
    """Events as loose rows, some without a subject or a confidence, made whole and judged."""
    n, user = F.col("event_id"), F.concat(F.lit("  user\t"), F.col("user_id").cast("string"), F.lit(" "))
    rows = I.table(spark, sf_dir, "events").select(
        user.alias("source"), F.when(n % 7 != 0, user).alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"),
        F.when(n % 3 != 0, F.col("value") / 100).alias("confidence"), F.col("ts").cast("timestamp_ntz").cast("string").alias("created_at"),
    )
    return M.make_facts(rows).select("source", "subject", "predicate", "object", "confidence", "active", "supersedes", "created_at", "fact_id", M.valid_fact().alias("valid")).distinct()


@query(f"""WITH {_SLOTS} SELECT 'chunk_' || substr(sha256(fact_id), 1, 12) AS chunk_id, conv_id, predicate, CASE WHEN active THEN 'true' ELSE 'false' END AS active, supersedes FROM states""")
def chunk_states(spark, sf_dir):
    """Chunks of facts with their state as metadata."""
    rows = M.chunks(M.slot_states(I.facts(spark, sf_dir)))
    return rows.select("chunk_id", "conv_id", *[F.col("meta")[c].alias(c) for c in ("predicate", "active", "supersedes")])


@query("SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 3 <> 0 AND len(embedding) = 64 AS valid FROM embeddings")
def chunk_validation(spark, sf_dir):
    """Vectors as chunks, some without an id, others with a component that is no number."""
    n = F.col("vec_id")
    rows = I.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(n % 5 != 0, n.cast("string")).alias("chunk_id"), F.col("label").cast("string").alias("text"),
        F.when(n % 3 != 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).alias("embedding"),
    )
    return rows.select("vec_id", M.valid_chunk(64).alias("valid"))


@query("""SELECT conv_id || ':' || turn AS id, text, 'conv:' || conv_id AS source, 64 AS dim, role, 'conv:' || conv_id AS of_source, CAST(turn AS VARCHAR) AS of_created FROM conversations WHERE text IS NOT NULL""")
def vector_rows(spark, sf_dir):
    """Turns as rows of a vector table; the stand-in embedder's components are left to the tests."""
    name = F.col("conv_id").cast("string")
    chunks = I.table(spark, sf_dir, "conversations").where("text is not null").select(
        F.concat_ws(":", name, F.col("turn").cast("string")).alias("chunk_id"), "text", F.concat(F.lit("conv:"), name).alias("source"), F.col("turn").alias("created_at"),
        F.create_map(F.lit("role"), "role", F.lit("gone"), F.lit(None).cast("string")).alias("meta"),
    )
    rows = vectors.vector_rows(chunks, vectors.hashing_embedder(64)).where(~F.map_contains_key("metadata", "gone"))
    of = F.col("metadata")
    return rows.select("id", "text", "source", F.size("vector").alias("dim"), of["role"].alias("role"), of["source"].alias("of_source"), of["created_at"].alias("of_created"))


@query("""SELECT conv_id, turn, CASE WHEN trim(regexp_extract(coalesce(text, ''), '(?i)the ([^.!?\n]+)', 1)) <> '' THEN trim(regexp_extract(coalesce(text, ''), '(?i)the ([^.!?\n]+)', 1))
  ELSE trim(coalesce(text, '')) END AS answer FROM conversations""")
def answers_in_texts(spark, sf_dir):
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_from_text("text", r"(?i)the ([^.!?\n]+)").alias("answer"))


@query(f"WITH {I.FACTS} SELECT conv_id, turn_id, subject, predicate, object, confidence, fact_id FROM facts")
def facts_as_json(spark, sf_dir):
    """Facts as JSON text and back."""
    rows = I.facts(spark, sf_dir).select("conv_id", "turn_id", "subject", "predicate", "object", "confidence", "fact_id")
    return S.facts_from_json(S.facts_to_json(rows), rows.schema)


@query(f"""WITH {I.FACTS}, rows AS (SELECT conv_id || ':' || object AS key, turn_id AS version, predicate, evidence FROM facts WHERE predicate IN ('view', 'click')),
old AS (SELECT key, max(version) AS version, 'view' AS predicate FROM rows WHERE predicate = 'view' GROUP BY key), new AS (SELECT key, max(version) AS version, 'click' AS predicate FROM rows WHERE predicate = 'click' GROUP BY key)
SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new""")
def chunk_upsert(spark, sf_dir):
    """Clicks replace views of the same thing."""
    rows = I.facts(spark, sf_dir).select(F.concat_ws(":", F.col("conv_id").cast("string"), "object").alias("key"), F.col("turn_id").alias("version"), "predicate")
    views = vectors.upsert(rows.limit(0), rows.where("predicate = 'view'"), "key", "version")
    return vectors.upsert(views, rows.where("predicate = 'click'"), "key", "version")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events
GROUP BY ALL HAVING arg_max(event_id % 97 = 0, event_id) = false""")
def keyed_upserts(spark, sf_dir):
    """The newest event of each user and kind, kept by a table that takes three batches, one of them twice; some take theirs away."""
    rows = I.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("k"), (F.col("event_id") % 97 == 0).alias("gone"))
    table = KeyedTable(spark, new_folder(spark, "keyed"), rows.drop("gone").schema, ("user_id", "event_type"), "event_id", ("user_id",), 16)
    for i in (1, 0, 0, 2):  # a batch of older events comes late, and is replayed
        table.upsert(rows.where(F.col("event_id") % 3 == i), (1, 0, 2).index(i), "gone")
    table.compact(2)
    return table.read()


def _kept(spark, sf_dir):
    """An index kept over four batches: early versions of some documents, then all, then documents that come and go."""
    docs, index = I.corpus(spark, sf_dir).withColumn("at", F.lit(2)), KeptIndex(spark, new_folder(spark, "index"), buckets=16)
    early = docs.where("doc % 3 = 0").withColumns({"at": F.lit(1), "text": F.concat(F.lit("an early version of "), F.reverse("text"))})
    passing = docs.where("doc % 5 = 0").withColumn("doc", -1 - F.col("doc"))
    for i, batch in enumerate((early.unionByName(passing), docs, early, passing.withColumns({"at": F.lit(3), "deleted": F.lit(True)}))):
        index.update(batch, i)
        index.update(batch, i)  # a replay
    index.compact(2)
    index.vacuum()
    return index.open()


@query(_SQL["bm25_term_statistics"])
def kept_index_statistics(spark, sf_dir):
    """Document frequencies and statistics of an index that batches change; they are those of the documents there are."""
    index = _kept(spark, sf_dir)
    return index.terms.join(index.stats, "scope").select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(_SQL["bm25_passages"])
def kept_index_passages(spark, sf_dir):
    """Passages searched in an index that is kept; rows are those of an index of all documents."""
    probes = I.passages(spark, sf_dir)
    found = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 5, index=_kept(spark, sf_dir))
    run = found.select("qid", "rank", "doc", "score", "text", F.lit("").alias("object"))
    return evaluation.judge(run, probes).select("qid", "rank", "doc", "score", "rel")


@query(_SQL["bm25_passages"])
def bounded_passages(spark, sf_dir):
    """Passages searched through blocks with bounds, some of whose documents were changed, added or removed since."""
    docs, index = I.corpus(spark, sf_dir).withColumn("at", F.lit(2)), KeptIndex(spark, new_folder(spark, "index"), buckets=16)
    early = docs.where("doc % 9 = 0").withColumns({"at": F.lit(1), "text": F.reverse("text")})
    passing = docs.where("doc % 9 = 1").withColumn("doc", -1 - F.col("doc"))
    index.update(docs.where("doc % 9 between 1 and 7").unionByName(early).unionByName(passing), 0)
    index.seal()
    index.update(docs.where("doc % 9 in (0, 8)").withColumn("deleted", F.lit(False)).unionByName(passing.withColumns({"at": F.lit(3), "deleted": F.lit(True)})), 1)
    probes = I.passages(spark, sf_dir)
    found = keyword.bm25_retrieve(probes, I.corpus(spark, sf_dir), 5, index=index.open())
    run = found.select("qid", "rank", "doc", "score", "text", F.lit("").alias("object"))
    return evaluation.judge(run, probes).select("qid", "rank", "doc", "score", "rel")


@query(f"""WITH {I.FACTS} SELECT conv_id, turn_id, coalesce(
    last_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    first_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), subject) AS subject, predicate, object FROM facts""")
def name_repair(spark, sf_dir):
    """The sequential fold where there are names alone, known before or learned late."""
    rows = I.facts(spark, sf_dir).withColumn("text", F.lit(""))
    return coref.repair(rows.select("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object", "text")).select("conv_id", "turn_id", "subject", "predicate", "object")


@query()
def pronoun_repair(spark, sf_dir):
    """The sequential fold over every user's events; no SQL, tests compare it with worked conversations."""
    rows = I.facts(spark, sf_dir).withColumn("text", F.col("evidence")).withColumn("subject", F.when(F.col("turn_id") % 3 == 0, "she").otherwise(F.col("subject")))
    return coref.repair(rows.select("conv_id", "turn_id", "fact_idx", "subject", "predicate", "object", "text"))


# graph memory


@query(f"SELECT DISTINCT conv_id, node FROM (WITH {I.WORLD} SELECT conv_id, unnest([subject, object]) AS node FROM world)")
def graph_nodes(spark, sf_dir):
    return graph.build_graph(I.world(spark, sf_dir))[0]


@query(f"WITH {I.WORLD} SELECT conv_id, subject AS src, predicate, object AS dst, fact_id FROM world")
def graph_edges(spark, sf_dir):
    return graph.build_graph(I.world(spark, sf_dir))[1].select("conv_id", "src", "predicate", "dst", "fact_id")


@query(f"WITH {I.QUESTIONS} SELECT qid, conv_id, 'Where' AS seed, 1 AS place FROM questions UNION ALL SELECT qid, conv_id, qid, 2 FROM questions")
def graph_seeds(spark, sf_dir):
    nodes, _ = graph.build_graph(I.world(spark, sf_dir))
    return graph.seeds_from_query(I.questions(spark, sf_dir), nodes)


_NEAR = f"""{I.WORLD}, {I.QUESTIONS}, sym AS (SELECT subject AS a, object AS b FROM world UNION SELECT object, subject FROM world),
h0 AS (SELECT qid, qid AS node, 0 AS hop FROM questions), h1 AS (SELECT DISTINCT h.qid, s.b AS node, 1 AS hop FROM h0 h JOIN sym s ON s.a = h.node),
h2 AS (SELECT DISTINCT h.qid, s.b AS node, 2 AS hop FROM h1 h JOIN sym s ON s.a = h.node),
near AS (SELECT qid, node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)"""


@query(f"WITH {_NEAR} SELECT qid, 'world' AS conv_id, node, hop FROM near")
def graph_frontier(spark, sf_dir):
    nodes, edges = graph.build_graph(I.world(spark, sf_dir))
    return graph.khop_frontier(graph.seeds_from_query(I.questions(spark, sf_dir), nodes), nodes, edges)


@query(f"""WITH {_NEAR}, cand AS (SELECT n.qid, w.fact_id, min(n.hop) AS hop FROM near n JOIN world w ON n.node IN (w.subject, w.object) GROUP BY ALL),
p AS (SELECT c.qid, c.hop, w.*, {_toks('q.query')} AS qt, {_toks('w.predicate')} AS pt, {_toks("w.subject || ' ' || w.predicate || ' ' || w.object")} AS ft
  FROM cand c JOIN world w USING (fact_id) JOIN questions q USING (qid)),
s AS (SELECT *, (0.55 * {_jac('qt', 'pt')} + 0.45 * confidence) / (1 + 0.3 * hop) AS path,
  0.45 * ((0.55 * {_jac('qt', 'pt')} + 0.45 * confidence) / (1 + 0.3 * hop)) + 0.30 * {_jac('qt', 'ft')} + 0.20 + CASE WHEN lower(subject) = lower(qid) OR lower(object) = lower(qid) THEN 0.05 ELSE 0 END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, hop, turn_id, fact_idx, fact_id) AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, subject, predicate, object, evidence AS text, hop, round(path, 6) AS path, round(score, 6) AS score FROM r WHERE rank <= 5""")
def graph_retrieval(spark, sf_dir):
    found = graph.graph_retrieve(I.questions(spark, sf_dir), I.world(spark, sf_dir), 5)
    return found.select("qid", "rank", "subject", "predicate", "object", "text", "hop", F.round("path", 6).alias("path"), F.round("score", 6).alias("score"))


_BUDGET = f"""walked AS (SELECT * FROM near JOIN questions USING (qid)), adj AS (SELECT subject AS node, 0 AS way, fact_id, turn_id, fact_idx FROM world UNION ALL SELECT object, 1, fact_id, turn_id, fact_idx FROM world),
visited AS (SELECT w.qid, a.fact_id, w.hop, row_number() OVER (PARTITION BY w.qid ORDER BY w.hop, w.node, a.way, a.turn_id, a.fact_idx, a.fact_id) AS visit FROM walked w JOIN adj a USING (node)),
cand AS (SELECT qid, fact_id, min(hop) AS hop FROM visited WHERE visit <= 40 GROUP BY ALL)"""


@query(_SQL["graph_retrieval"].replace("cand AS (SELECT n.qid, w.fact_id, min(n.hop) AS hop FROM near n JOIN world w ON n.node IN (w.subject, w.object) GROUP BY ALL)", _BUDGET).replace("rank <= 5", "rank <= 60"))
def graph_budget(spark, sf_dir):
    """All facts that a question gets for 40 visits of edges; a nation is a hub with more."""
    found = graph.graph_retrieve(I.questions(spark, sf_dir), I.world(spark, sf_dir), 60, max_visits=40)
    return found.select("qid", "rank", "subject", "predicate", "object", "text", "hop", F.round("path", 6).alias("path"), F.round("score", 6).alias("score"))


@query(_SQL["graph_retrieval"].replace(" + 0.20 + ", " + 0.20 * pow(0.5, turn_id / 7.0) + "))
def graph_recency(spark, sf_dir):
    """The same with facts that lose half of their recency in a week; a turn is a day here."""
    states = I.world(spark, sf_dir).withColumn("age_s", F.col("turn_id") * 86400.0)
    found = graph.graph_retrieve(I.questions(spark, sf_dir), states, 5, half_life_s=7 * 86400.0)
    return found.select("qid", "rank", "subject", "predicate", "object", "text", "hop", F.round("path", 6).alias("path"), F.round("score", 6).alias("score"))


@query(f"""WITH best AS ({_SQL["graph_retrieval"]}) SELECT qid, rank, 'graph' AS system, 'graph_edge' AS type, subject, object, text, score, path AS score_path, CAST(hop AS DOUBLE) AS score_hop, CAST(NULL AS DOUBLE) AS score_none FROM best""")
def envelope_scores(spark, sf_dir):
    """Graph results in the shared form with the parts of their scores."""
    found = graph_retrieval(spark, sf_dir).withColumns({"type": F.lit("graph_edge"), "none": F.lit(None).cast("double")})
    rows = rerank.envelope(found, "graph", ("path", "hop", "none"))
    part = F.col("scores")
    return rows.select("qid", "rank", "system", "type", "subject", "object", "text", "score", part["path"].alias("score_path"), part["hop"].alias("score_hop"), part["none"].alias("score_none"))


@query(f"""WITH {_NEAR}, asked AS (SELECT q.qid, q.query, CASE n.n_nationkey % 3 WHEN 0 THEN n.n_name ELSE '' END AS qs, CASE WHEN n.n_nationkey % 3 < 2 THEN 'part_of' ELSE '' END AS qp,
  CASE n.n_nationkey % 3 WHEN 1 THEN n.n_name ELSE '' END AS qo FROM questions q JOIN nation n ON n.n_name = q.qid),
cand AS (SELECT n.qid, w.fact_id, min(n.hop) AS hop FROM near n JOIN world w ON n.node IN (w.subject, w.object) GROUP BY ALL),
t AS (SELECT c.qid, c.hop, w.*, qs, qp, qo, {_toks('q.query')} AS qt, {_toks('w.predicate')} AS pt, {_toks("w.subject || ' ' || w.predicate || ' ' || w.object")} AS ft,
  CAST(qs <> '' AND {_jac(_toks('qs'), _toks('w.subject'))} >= 0.5 AS INTEGER) AS gs, CAST(qp <> '' AND {_jac(_toks('qp'), _toks('w.predicate'))} >= 0.5 AS INTEGER) AS gp,
  CAST(qo <> '' AND {_jac(_toks('qo'), _toks('w.object'))} >= 0.5 AS INTEGER) AS go FROM cand c JOIN world w USING (fact_id) JOIN asked q USING (qid)),
p AS (SELECT *, (0.55 * {_jac('qt', 'pt')} + 0.45 * confidence) / (1 + 0.3 * hop) + 0.1 * (gs + gp + go) AS path FROM t),
s AS (SELECT *, 0.45 * path + 0.30 * {_jac('qt', 'ft')} + 0.20 + CASE WHEN lower(subject) = lower(qid) OR lower(object) = lower(qid) THEN 0.05 ELSE 0 END + 0.05 * (gp + go) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, hop, turn_id, fact_idx, fact_id) AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, subject, predicate, object, hop, round(path, 6) AS path, round(score, 6) AS score FROM r WHERE rank <= 5""")
def graph_guided(spark, sf_dir):
    """Questions with a fact that a reply makes of them: it seeds the search and guides the scores."""
    n, name = F.col("n_nationkey") % 3, F.col("n_name")
    made = F.when(n == 0, F.concat(F.lit('Here: [{"subject": " '), name, F.lit(' ", "predicate": "Part-Of", "object": ""}]')))
    made = made.when(n == 1, F.concat(F.lit('```json\n[{"predicate": "part of", "object": "'), name, F.lit('"}]\n```'))).otherwise(F.lit("[]"))
    replies = I.table(spark, sf_dir, "nation").select(name.alias("qid"), made.alias("reply"))
    asked = graph.parse_query_fact(I.questions(spark, sf_dir), replies)
    found = graph.graph_retrieve(asked, I.world(spark, sf_dir), 5)
    return found.select("qid", "rank", "subject", "predicate", "object", "hop", F.round("path", 6).alias("path"), F.round("score", 6).alias("score"))


# vector memory


def _vectors(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("conv_id"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10""")
def knn_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = vectors.knn(rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "v"), rows.select("id", "v"), 10)
    return found.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _states(rows):
    return rows.select(
        F.col("id").alias("fact_id"), "conv_id", F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.col("id").cast("string").alias("object"),
        F.col("id").cast("string").alias("evidence"), (F.col("id") % 3 != 0).alias("active"),
    )


def _retrieved(spark, sf_dir, mode):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "conv_id", "v")
    found = vectors.vector_retrieve(asked, _states(rows), rows.select(F.col("id").alias("fact_id"), "v"), 3, mode)
    return found.select("qid", "rank", "fact_id", "text", "score")


@query(f"""SELECT qid, CAST(rank AS INTEGER) AS rank, fact_id, CAST(fact_id AS VARCHAR) AS text, round(score, 6) AS score FROM (
  SELECT a.vec_id AS qid, b.vec_id AS fact_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0 AND b.vec_id % 3 <> 0) WHERE rank <= 3""")
def vectors_prefiltered(spark, sf_dir):
    return _retrieved(spark, sf_dir, "prefilter")


@query(f"""WITH wide AS (SELECT a.vec_id AS qid, a.label AS own, b.label, b.vec_id AS fact_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS k
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, fact_id, CAST(fact_id AS VARCHAR) AS text, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, fact_id) AS rank FROM wide WHERE k <= 15 AND own = label AND fact_id % 3 <> 0) WHERE rank <= 3""")
def vectors_postfiltered(spark, sf_dir):
    return _retrieved(spark, sf_dir, "postfilter")


# sources and curation


@query("SELECT 'conv_' || conv_id AS conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_id, role, text FROM conversations")
def nested_to_turns(spark, sf_dir):
    return S.explode_turns(I.nested(spark, sf_dir))


@query(f"""WITH {I.NESTED} SELECT conversation_id || '::1' AS qid, conversation_id AS conv_id, 1 AS q_idx, trim(question, ' ' || chr(10)) AS question, trim(answer, ' ' || chr(10)) AS expected, quote AS quoted
FROM nested WHERE question IS NOT NULL AND trim(question, ' ' || chr(10)) <> ''""")
def nested_to_probes(spark, sf_dir):
    return S.explode_probes(I.nested(spark, sf_dir)).select("qid", "conv_id", "q_idx", "question", "expected", F.array_join("relevant_texts", "|").alias("quoted"))


@query(f"""WITH {I.NESTED} SELECT conversation_id, scenario, difficulty, lower(trim(question, ' ' || chr(10))) AS question, lower(trim(answer, ' ' || chr(10))) AS expected,
  regexp_replace(lower(trim(quote, ' ' || chr(10))), '[ \\t\\r\\n.!?、。！？…]+$', '') AS quoted, CASE WHEN bad_role THEN 'invalid role' WHEN question IS NULL THEN 'no eval' END AS reject_reason FROM nested""")
def curation_validated(spark, sf_dir):
    e = F.get("eval", F.lit(0))
    return curate.validate(I.nested(spark, sf_dir)).select(
        "conversation_id", "scenario", "difficulty", e["question"].alias("question"), e["expected_answer"].alias("expected"), F.array_join(e["relevant_texts"], "|").alias("quoted"), "reject_reason"
    )


@query(f"""WITH {I.NESTED}, good AS (SELECT *, lower(trim(question, ' ' || chr(10))) AS q, regexp_replace(lower(trim(quote, ' ' || chr(10))), '[ \\t\\r\\n.!?、。！？…]+$', '') AS e FROM nested WHERE NOT bad_role AND question IS NOT NULL)
SELECT scenario, difficulty, count(*) AS n, round(avg(CAST(regexp_full_match(q, '[^?]*\\?') AS INTEGER)), 6) AS one_mark, round(avg(CAST(length(q) <= 120 AS INTEGER)), 6) AS short_question,
  round(avg(CAST(NOT regexp_matches(q, ' and | or | as well as |[,;:/&]') AS INTEGER)), 6) AS one_fact, round(avg(CAST(length(e) BETWEEN 5 AND 140 AS INTEGER)), 6) AS fine_quotes,
  round(avg(CAST(CASE difficulty WHEN 'easy' THEN n_turns BETWEEN 4 AND 6 ELSE n_turns BETWEEN 8 AND 10 END AS INTEGER)), 6) AS turn_count FROM good GROUP BY ALL""")
def curation_audit(spark, sf_dir):
    good, _ = curate.split_valid(I.nested(spark, sf_dir))
    rates = curate.audit_rates(curate.audit(good))
    return rates.select("scenario", "difficulty", "n", *[F.round(c, 6).alias(c) for c in ("one_mark", "short_question", "one_fact", "fine_quotes", "turn_count")])


@query(f"WITH {I.NESTED} SELECT scenario, difficulty, count(*) AS n FROM nested GROUP BY ALL")
def curation_counts(spark, sf_dir):
    return curate.counts(curate.validate(I.nested(spark, sf_dir)))


_FORMS = "(SELECT unnest(['lines', 'concatenated', 'array']) AS form)"


@query(f"""SELECT form, 'conv_' || conv_id AS conv_id, CAST(row_number() OVER (PARTITION BY form, conv_id ORDER BY turn) AS INTEGER) AS turn_id, role, coalesce(text, '') AS text FROM conversations, {_FORMS}""")
def read_forms(spark, sf_dir):
    """Conversations written in each form and read again: objects in lines, one behind the other, arrays in lines."""
    made, folder = I.nested(spark, sf_dir), new_folder(spark, "forms")
    S.write_dataset(made, f"{folder}/lines")
    one = F.to_json(F.struct(*made.columns))
    made.select(one).write.option("lineSep", " ").text(f"{folder}/concatenated")
    made.select(F.concat(F.lit("["), one, F.lit("]"))).write.text(f"{folder}/array")
    rows = [S.explode_turns(S.read_conversations(spark, f"{folder}/{name}", name)).withColumn("form", F.lit(name)) for name in ("lines", "concatenated")]
    return rows[0].unionByName(rows[1]).unionByName(S.explode_turns(S.read_conversations(spark, f"{folder}/array", "lines")).withColumn("form", F.lit("array")))


@query(f"WITH {_EVAL} SELECT 'keyword' AS system, qid, em, hits, retrieved, rank, (SELECT round(avg(hit), 6) FROM ev) AS mean_hit FROM ev")
def written_results(spark, sf_dir):
    """An evaluation written as its three tables and read again."""
    rows, folder = _evaluated(spark, sf_dir).withColumn("system", F.lit("keyword")), new_folder(spark, "results")
    S.write_results(rows, rows.groupBy("system").agg(F.avg("hit").alias("mean_hit")), rows.select("system", "qid", "rank", "retrieved"), folder, "parquet")
    table = lambda name: spark.read.parquet(f"{folder}/{name}")
    both = table("per_query").select("system", "qid", "em", "hits").join(table("diagnostics"), ["system", "qid"]).join(table("macro"), "system")
    return both.select("system", "qid", "em", "hits", "retrieved", "rank", F.round("mean_hit", 6).alias("mean_hit"))


@query("""WITH cells AS (SELECT s, d, t, turns FROM (SELECT unnest(['simple', 'update', 'multihop']) AS s), (VALUES ('easy', 0.6, '4-6'), ('moderate', 0.8, '4-8'), ('complex', 1.0, '8-10')) c(d, t, turns)),
ids AS (SELECT unnest(range(0, (SELECT count(DISTINCT conv_id) FROM conversations))) AS i), twice AS (SELECT unnest([1, 2]))
SELECT printf('%s_%s_7_%03d', upper(s), upper(d), i) AS conversation_id, s AS scenario, d AS difficulty, t::DOUBLE AS temperature, 'Write JSON.' AS system,
  d || ' ' || s || ' of ' || turns || ' turns' AS user, 'm' AS model FROM cells, ids, twice""")
def prompt_log(spark, sf_dir):
    """As many prompts of each kind as there are conversations, logged twice as JSON lines."""
    n, path = I.table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).first()[0], new_folder(spark, "prompts")
    prompts = curate.generation_prompts(curate.generation_grid(spark, n), "Write JSON.", "{difficulty} {scenario} of {n_turns} turns", "m").drop("row_seed")
    S.write_dataset(prompts, path)
    S.write_dataset(prompts, path, append=True)
    return spark.read.schema(prompts.schema).json(path)


@query(_SQL["curation_validated"])
def replies_validated(spark, sf_dir):
    """Conversations as a model's replies, with words around the JSON; labels are those that were asked for."""
    made = I.nested(spark, sf_dir)
    reply = F.concat(F.lit("Here it is: "), F.to_json(F.struct(*[c for c in made.columns if c != "difficulty"])), F.lit(" as asked"))
    e = F.get("eval", F.lit(0))
    return curate.parse_generated(made.select("conversation_id", "scenario", "difficulty", reply.alias("reply"))).select(
        "conversation_id", "scenario", "difficulty", e["question"].alias("question"), e["expected_answer"].alias("expected"), F.array_join(e["relevant_texts"], "|").alias("quoted"), "reject_reason"
    )


@query("""SELECT conv_id, CAST(turn + 1 AS INTEGER) AS turn_id, 0 AS fact_idx, 'me' AS subject, 'wrote' AS predicate, CAST(length(coalesce(text, '')) AS VARCHAR) AS object, 0.5::DOUBLE AS confidence, 's' AS evidence
FROM conversations WHERE length(coalesce(text, '')) % 2 = 0""")
def facts_extracted(spark, sf_dir):
    """Facts of turns by a plain function in the place of a model; it has none for texts of odd length."""

    def extractor(texts):
        reply = '[{{"subject": "me", "predicate": "wrote", "object": "{}", "confidence": 0.5, "source_span": "s"}}]'
        return texts.fillna("").str.len().map(lambda n: "nothing" if n % 2 else reply.format(n))

    return M.parse_replies_plain(M.extract_facts(I.turns(spark, sf_dir), extractor))


@query("SELECT conv_id, turn, length(text) AS characters, length(text) - length(replace(text, 'e', '')) AS e FROM conversations")
def turns_embedded(spark, sf_dir):
    """Texts embedded by a plain function in the place of a model, each distinct text once."""
    rows = vectors.embed_batch(I.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), lambda texts: [[len(t), t.count("e")] for t in texts])
    return rows.select("conv_id", "turn", F.get("embedding", F.lit(0)).cast("long").alias("characters"), F.get("embedding", F.lit(1)).cast("long").alias("e"))


@query(f"WITH {I.FACTS} SELECT predicate, count(*) AS before, 0 AS after FROM facts GROUP BY predicate")
def memory_reset(spark, sf_dir):
    """A table of facts before and after it is emptied."""
    path = new_folder(spark, "reset")
    I.facts(spark, sf_dir).write.parquet(path)
    before = spark.read.parquet(path).groupBy("predicate").agg(F.count("*").alias("before"))
    kept = spark.createDataFrame(before.collect(), before.schema)  # a row for each predicate
    S.reset(spark.read.parquet(path), path)
    after = spark.read.parquet(path).groupBy("predicate").agg(F.count("*").alias("after"))
    return kept.join(after, "predicate", "left").na.fill(0, ["after"])


# streams


def _folder(spark):
    return new_folder(spark, "stream")


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query(f"""WITH {I.TURNS}, u AS (SELECT conv_id, {_norm('text')} AS text FROM turns WHERE lower(role) = 'user')
  SELECT DISTINCT conv_id, text FROM u WHERE text <> '' AND NOT (contains(text, '?') OR regexp_matches(text, '^\\s*(what|who|whom|whose|which|where|when|why|how)\\b', 'i'))""")
def stream_documents(spark, sf_dir):
    """User turns from a stream of files, each text of a conversation once."""
    return R.drain(R.stream_docs(_stream(spark, sf_dir, "conversations")).select("conv_id", "text"), "append", _folder(spark))


@query(f"""WITH {I.TURNS}, u AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, {_norm('text')} AS text FROM turns WHERE lower(role) = 'user')
  SELECT DISTINCT conv_id, text FROM u WHERE text <> '' AND NOT (contains(text, '?') OR regexp_matches(text, '^\\s*(what|who|whom|whose|which|where|when|why|how)\\b', 'i'))""")
def stream_requests(spark, sf_dir):
    """The same from insert requests, written as JSON lines, some of them twice."""
    rows, path = I.turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("conv_id"), "turn_id", "role", F.col("text").alias("content")), new_folder(spark, "requests")
    rows.unionByName(rows.where("turn_id % 2 = 0")).write.json(path)
    return R.drain(R.stream_docs(S.read_turn_stream(spark, path)).select("conv_id", "text"), "append", _folder(spark))


_REPAIRED = f"""WITH {I.FACTS} SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn_id, coalesce(
    last_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    first_value(CASE WHEN predicate = 'name' THEN object END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), subject) AS subject, predicate, object FROM facts"""


def _repaired(spark, sf_dir, how):
    """The last that a stream of facts puts out for each one."""
    facts = I.facts(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("string")).withColumn("text", F.lit(""))
    path = new_folder(spark, "facts")
    facts.write.parquet(path)
    changes = R.drain(how(spark.readStream.schema(facts.schema).parquet(path)), "update", _folder(spark))
    return changes.where("not late").select("conv_id", "turn_id", "subject", "predicate", "object")


@query(_REPAIRED)
def stream_repaired_facts(spark, sf_dir):
    """Facts repaired in a stream: the last that comes out for each one, names that are learned late included."""
    return _repaired(spark, sf_dir, R.stream_repaired)


@query(_REPAIRED)
def stream_repaired_by_keys(spark, sf_dir):
    """The same, with a state by entity and token in the place of one for a conversation."""
    from convrecall.streaming import repair_state  # it needs protobuf, which nothing else does

    with repair_state.rocksdb(spark):
        return _repaired(spark, sf_dir, repair_state.stream_repaired_keyed)


@query("""SELECT CAST(user_id AS VARCHAR) AS conv_id, event_type AS predicate, arg_max(json_extract_string(props, '$.k'), event_id) AS object, CAST(max(event_id) AS INTEGER) AS turn_id
FROM events GROUP BY ALL""")
def stream_current_slots(spark, sf_dir):
    """The current fact of every slot, kept by state from a stream of events; the order is that of event_id."""
    facts = _stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("conv_id"), F.lit("<USER>").alias("subject"), F.col("event_type").alias("predicate"), F.get_json_object("props", "$.k").alias("object"),
        F.col("event_id").cast("int").alias("turn_id"), F.lit(0).alias("fact_idx"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fact_id"),
    )
    changes = R.drain(R.stream_slots(facts), "update", _folder(spark))
    last = Window.partitionBy("conv_id", "predicate").orderBy(F.desc("turn_id"))
    now = changes.where("active").withColumn("again", F.row_number().over(last)).where("again = 1")
    return now.select("conv_id", "predicate", "object", "turn_id")


_BROUGHT = """brought AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN 2 WHEN ts < (SELECT to_timestamp(avg(epoch(ts))) FROM events) THEN 0 ELSE 1 END AS batch FROM events),
latest AS (SELECT batch, max(ts) AS latest FROM brought GROUP BY batch), marked AS (SELECT b.*, (SELECT max(latest) - INTERVAL 3 DAY FROM latest l WHERE l.batch < b.batch) AS mark FROM brought b),
timely AS (SELECT *, row_number() OVER (PARTITION BY batch, user_id, event_type ORDER BY ts, event_id) AS k FROM marked WHERE mark IS NULL OR ts >= mark)"""


def _unseen(batch: int) -> str:
    """What batch goes on with: the first of each key that is timely, unless a batch before has brought it within the watermark."""
    before = " UNION ALL ".join(f"SELECT * FROM e{b}" for b in range(batch)) or "SELECT * FROM timely WHERE false"
    return f"""e{batch} AS (SELECT t.* FROM timely t WHERE batch = {batch} AND k = 1
  AND NOT EXISTS (SELECT 1 FROM ({before}) s WHERE s.user_id = t.user_id AND s.event_type = t.event_type AND s.ts >= t.mark))"""


@query(f"""WITH {_BROUGHT}, {", ".join(map(_unseen, range(3)))}
SELECT event_id, batch, false AS late FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) UNION ALL SELECT event_id, batch, true FROM marked WHERE ts < mark""")
def stream_event_time(spark, sf_dir):
    """Events in three batches, the last with some of all times: each user's kinds of event once within a watermark of three days, and what comes late."""
    rows = I.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    middle = rows.agg(F.timestamp_seconds(F.avg(F.unix_micros("ts") / 1e6)).alias("m")).first()["m"]
    number = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("ts") < F.lit(middle), 0).otherwise(1)
    sink = EventTime(spark, new_folder(spark, "times"), rows.schema, ("user_id", "event_type"), "ts", 3 * 86400, ("event_id",), 16)
    for i in (0, 1, 1, 2):  # a batch is replayed
        sink(rows.where(number == i), i)
    return sink.rows().withColumn("late", F.lit(False)).unionByName(sink.late().withColumn("late", F.lit(True))).select("event_id", "batch", "late")
