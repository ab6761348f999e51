"""Relevance over whole corpora: which documents hold an answer or a quote, by a containment join.

A text that holds a needle holds the needle's words, those between two spaces as whole words and those at its ends as
ends of words. So a needle is looked up by the rarest of its whole words or, where it has none, by the words of the
corpus that its end can be part of; these are found in the vocabulary by the rarest of the end's grams. What is found
is verified. Every join is one on equality, of words, grams or documents; no needle meets a text without its anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convrecall.functions import text as T
from convrecall.sources.shared import stored

#: Length of the grams that ends of words are looked up by; shorter ends are grams themselves.
GRAM = 3
INSIDE, ENDS, STARTS, WHOLE = range(4)


def _words(text: str) -> Column:
    """The distinct runs between spaces; other white space is part of them, as needles have it too."""
    return F.array_distinct(F.array_remove(F.split(text, " "), ""))


def _grams(word: str, n: int) -> Column:
    """The distinct runs of ``n`` characters of a word that has as many; linear in the word."""
    chars = F.regexp_extract_all(F.col(word), F.lit("(?s)."), 0)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])))


def _pieces(needles: DataFrame) -> DataFrame:
    """``(scope, needle, pos, piece, kind)``: the words of a needle, whole ones alone where it has any."""
    split = needles.select("scope", "needle", F.split("needle", " ").alias("all"))
    each = split.select("scope", "needle", F.size("all").alias("n"), F.posexplode("all").alias("pos", "piece")).where("piece <> ''")
    begins, ends = F.col("pos") > 0, F.col("pos") < F.col("n") - 1
    each = each.withColumn("kind", F.when(begins & ends, WHOLE).when(begins, STARTS).when(ends, ENDS).otherwise(INSIDE))
    best = each.groupBy("scope", "needle").agg((F.max("kind") == WHOLE).alias("whole"))
    return each.join(best, ["scope", "needle"]).where(f"not whole or kind = {WHOLE}").drop("whole", "n")


def _options(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(scope, needle, pos, token, df)``: the words of the corpus that a piece may stand in."""
    whole = pieces.where(f"kind = {WHOLE}").join(vocabulary.withColumnRenamed("token", "piece"), ["scope", "piece"])
    whole = whole.select("scope", "needle", "pos", F.col("piece").alias("token"), "df")
    open_ = pieces.where(f"kind <> {WHOLE}").withColumn("size", F.least(F.length("piece"), F.lit(GRAM)))
    asked = made = None
    for n in sorted(r["size"] for r in open_.select("size").distinct().collect()):  # GRAM rows at most
        a = open_.where(F.col("size") == n).select("scope", "needle", "pos", "piece", "kind", F.explode(_grams("piece", n)).alias("gram"))
        m = vocabulary.where(F.length("token") >= n).select("scope", "token", "df", F.explode(_grams("token", n)).alias("gram"))
        asked, made = (a, m) if asked is None else (asked.unionByName(a), made.unionByName(m))
    if asked is None:
        return whole
    asked = stored(asked)
    made = stored(made.join(asked.select("scope", "gram").distinct(), ["scope", "gram"], "left_semi"))
    counts = made.groupBy("scope", "gram").agg(F.sum("df").alias("found"))
    rarest = asked.join(counts, ["scope", "gram"], "left").groupBy("scope", "needle", "pos", "piece", "kind").agg(
        F.min_by("gram", F.struct(F.coalesce("found", F.lit(0)), "gram")).alias("gram")
    )
    fits = F.when(F.col("kind") == STARTS, F.startswith("token", "piece")).when(F.col("kind") == ENDS, F.endswith("token", "piece")).otherwise(F.contains("token", "piece"))
    return whole.unionByName(rarest.join(made, ["scope", "gram"]).where(fits).select("scope", "needle", "pos", "token", "df"))


def containment(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Each ``(scope, needle, doc)`` once where a text of ``texts`` (scope, doc, text) holds a needle of ``needles`` (scope, needle).

    Both sides are compared as they are. Empty and null needles, null texts and rows without a scope are in no result;
    needles of spaces alone have no word and are not looked for. Repeats are harmless. Other columns are not read.
    """
    needles = needles.select("scope", "needle").where("needle <> '' and scope is not null").distinct()
    words = texts.select("scope", "doc", F.explode(_words("text")).alias("token"))
    vocabulary = stored(words.groupBy("scope", "token").agg(F.count("*").alias("df")))
    pieces = stored(_pieces(needles))
    options = stored(_options(pieces, vocabulary))
    # a piece that no word has leaves its needle without documents; of the others the rarest is the anchor
    found = options.groupBy("scope", "needle", "pos").agg(F.sum("df").alias("found"))
    rarest = pieces.join(found, ["scope", "needle", "pos"], "left").groupBy("scope", "needle").agg(F.min(F.struct(F.coalesce("found", F.lit(0)).alias("found"), "pos")).alias("x"))
    chosen = rarest.where("x.found > 0").select("scope", "needle", F.col("x.pos").alias("pos"))
    anchors = options.join(chosen, ["scope", "needle", "pos"], "left_semi").select("scope", "token", "needle").distinct()
    met = words.join(anchors, ["scope", "token"]).select("scope", "needle", "doc").distinct()
    return met.join(texts.select("scope", "doc", "text"), ["scope", "doc"]).where(F.contains("text", "needle")).select("scope", "needle", "doc").distinct()


def corpus_qrels(probes: DataFrame, docs: DataFrame) -> DataFrame:
    """Each relevant ``(qid, doc)`` once, of ``probes`` (qid, scope, expected, relevant_texts) in ``docs`` (scope, doc, text, maybe object).

    The rule is that of ``evaluation.relevant``: the expected answer is in the text or object, or a relevant text is in the
    text; all are compared as normal answers. Documents are those of the probe's scope. A probe with nothing to look
    for has none.
    """
    answers = probes.select("qid", "scope", T.norm_answer("expected").alias("needle"))
    quotes = probes.select("qid", "scope", F.explode("relevant_texts").alias("needle")).withColumn("needle", T.norm_answer("needle"))
    wanted = answers.unionByName(quotes)
    pairs = wanted.join(containment(wanted, docs.select("scope", "doc", T.norm_answer("text").alias("text"))), ["scope", "needle"]).select("qid", "doc")
    if "object" in docs.columns:
        held = containment(answers, docs.select("scope", "doc", T.norm_answer("object").alias("text")))
        pairs = pairs.unionByName(answers.join(held, ["scope", "needle"]).select("qid", "doc"))
    return pairs.distinct()


def totals(qrels: DataFrame) -> DataFrame:
    """``(qid, n_rel)``: how many documents are relevant to each query that has any."""
    return qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
