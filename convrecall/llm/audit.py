"""How filters interact: what each takes in every order, what is redundant, and its Shapley share.

Documents become failure masks, one bit for each filter, and masks become counted cells: at most 2^n for each part of
the corpus. Each cell is folded across the array of all orders with ``transform`` and ``aggregate``, which gives a
struct of weighted counts for every order and step; the arrays of a part's cells are merged by elementwise sums. The
array of orders is a literal in the plan, so that every task has it.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

#: Partitions that rows without a doc_id are dealt to where documents meet their labels.
SALT = 1024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: counted rows of documents; bits of ``mask`` are the filters A to E, lowest first.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. E fails a document whose text a
    smaller doc_id has too, anywhere in the table. Null texts are empty and null sources the part ''. A row without a
    doc_id has no smaller one, is smaller than none and has no labels. Repeated rows count each; a document with
    several labels is good or toxic if one of them says so. Other columns are not read.

    Texts are compared by their SHA-256 and never shuffled. Rows of one text are counted before they meet, so that
    copies of a text are a row for each part and label.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters(text).values())), F.lit(0))
    unnamed = F.col("doc_id").isNull()
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"),
        F.when(unnamed, 1 + F.pmod(F.xxhash64("text", "source"), F.lit(SALT))).otherwise(0).alias("salt"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("at"),
    )
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("at")).agg(flag("quality"), flag("toxic"))
    rows = rows.join(known.withColumn("salt", F.lit(0).cast("long")), ["at", "salt"], "left")
    rows = rows.na.fill(0, ["quality", "toxic"]).groupBy("key", "part", "mask", "quality", "toxic", "doc_id").agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    alike = rows.groupBy("key", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least")
    )
    first = alike.groupBy(F.col("key").alias("key2")).agg(F.min("least.doc_id").alias("first"))
    alike = alike.join(first, F.col("key") == F.col("key2"))
    again = F.col("named") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - again).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), again.alias("n")))
    split = alike.select("part", "quality", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _fold(cell: Column, orders: Column) -> Column:
    """An array of structs, for every order its steps: what the cell's documents count there."""
    bits, n, good, toxic = cell["mask"], cell["n"], cell["good"], cell["toxic"]
    when = lambda c, x: F.when(c, x).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, bit: Column) -> Column:
        gone, fails = bits.bitwiseAND(acc["before"]) != 0, bits.bitwiseAND(bit) != 0
        here = ~gone & fails
        made = F.struct(
            bit.alias("bit"), when(~gone & ~fails, n).alias("kept"), when(here, n).alias("removed"), when(gone & fails, n).alias("redundant"),
            when(bits == bit, n).alias("unique_fails"), when(here, good).alias("good_lost"), when(here, toxic).alias("toxic_lost"),
        )
        return F.struct(acc["before"].bitwiseOR(bit).alias("before"), F.concat(acc["out"], F.array(made)).alias("out"))

    kind = f"array<struct<bit: int, {', '.join(f'{c}: bigint' for c in COUNTS)}>>"
    start = F.struct(F.lit(0).alias("before"), F.array().cast(kind).alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step)["out"]))


def interactions(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``(part, filter_order, step, kept, ..., shapley)`` of counted cells ``(part, mask, n, good, toxic)``.

    A row for each part, order of the filters and step, zeros included. ``shapley`` is what the step's filter removes,
    summed over all orders. A part has one cell for each mask (rows of one mask are added up), so what is collected
    for it is bounded by the filters. Without cells there are no rows.
    """
    names = ["".join(p) for p in permutations(letters)]
    orders = F.array(*[F.array(*[F.lit(1 << letters.index(x)) for x in name]) for name in names])
    whole = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = whole.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    nothing = F.struct(F.lit(0).alias("bit"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    add = lambda a, b: F.struct(F.greatest(a["bit"], b["bit"]).alias("bit"), *[(a[c] + b[c]).alias(c) for c in COUNTS])
    zeros = F.array_repeat(nothing, len(names) * len(letters))
    parts = parts.select("part", F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, _fold(cell, orders), add)).alias("steps"))
    taken = lambda i: F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.when(s["bit"] == 1 << i, s["removed"]).otherwise(0))
    parts = parts.select("part", "steps", F.array(*[taken(i) for i in range(len(letters))]).alias("taken"))
    rows = parts.select("part", "taken", F.posexplode("steps").alias("pos", "s"))
    place = (F.col("pos") % len(letters)).cast("int")
    return rows.select(
        "part", F.get(F.lit(names), F.floor(F.col("pos") / len(letters)).cast("int")).alias("filter_order"), (place + 1).alias("step"), *[f"s.{c}" for c in COUNTS],
        F.get("taken", F.log2("s.bit").cast("int")).alias("shapley"),
    )


OP11_SQL = r"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t
), marks AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f FROM texts JOIN firsts USING (t)
), known AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END)
    || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM marks LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT *, contains(failed, substr(filter_order, step, 1)) AS fails, regexp_matches(failed, '[' || substr(filter_order, 1, step - 1) || '-]') AS gone, substr(filter_order, step, 1) AS x
  FROM cells, orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
), counted AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted"""


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all orders, for each source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(failures(docs, labels))
