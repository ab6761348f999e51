"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens is dealt down a tree (domain, language, source) by weight. What a branch cannot use goes to its
siblings first; only what all of them cannot use is felt one level up. Each leaf then takes the documents of seeded
epochs, in a shuffled order, up to its budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from convrecall.llm.common import checkpoint

LEVELS = ("domain", "lang", "source")
#: Hex digits of the shuffle key that number a leaf's slices: 16^3 of them, whatever the leaf's size.
DIGITS = 3
#: Leaves (three names and four numbers each) that may be broadcast to the documents; beyond, a join shuffles.
BROADCAST_LEAVES = 50_000


def joined(a: DataFrame, b: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Inner join on columns that both have, null to null; all columns of ``a`` and the others of ``b``."""
    b = b.withColumnsRenamed({c: f"{c}__b" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__b"))
    return a.join(b, on).drop(*[f"{c}__b" for c in columns])


def _water(nodes: DataFrame, parent: list[str], given: str) -> DataFrame:
    """Deal each parent's ``given`` to its nodes by ``weight``, none more than its ``room``; adds ``budget``.

    Nodes are taken by room for each weight. Those before the first that its share does not fill are full; the others
    split the rest by weight. A node of weight 0 gets nothing.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), *[c for c in nodes.columns if c in LEVELS])
    used = F.coalesce(F.sum("room").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("share", (F.col(given) - used) / left)
    first = F.max(F.when(F.col("room") > F.col("share") * F.col("weight"), F.col("share"))).over(Window.partitionBy(*parent))
    return nodes.withColumn("budget", F.least(F.col("room"), F.coalesce(first * F.col("weight"), F.col("room")))).drop("share")


def budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str | None, float]], default: float = 1.0) -> DataFrame:
    """``(domain, lang, source, budget)`` from leaves ``(domain, lang, source, room)``; budgets are whole tokens.

    ``weights`` has for a level the weights of its names, the same under every parent; names without one get
    ``default``. The tree has a node for each combination that occurs, so it is small beside the documents.
    """

    def weight(level: str) -> F.Column:
        own = F.lit(float(default))
        for name, w in weights.get(level, {}).items():
            own = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(own)
        return own

    above = leaves.groupBy().agg(F.least(F.lit(float(total)), F.coalesce(F.sum("room"), F.lit(0.0))).alias("given")).withColumn("root", F.lit(0))
    path = ["root"]
    for depth, level in enumerate(LEVELS, 1):
        own = list(LEVELS[:depth])
        rooms = leaves.withColumn("weight", weight(level)).withColumn("root", F.lit(0))
        nodes = rooms.where("weight > 0").groupBy("root", *own).agg(F.sum("room").alias("room"), F.max("weight").alias("weight"))
        dealt = _water(joined(nodes, above, path), path, "given")
        above = dealt.select("root", *own, F.col("budget").alias("given"))
        path = ["root", *own]
    return above.select(*LEVELS, F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def mixed(
    docs: DataFrame, domain: F.Column, tokens: F.Column, share: float, weights: dict[str, dict[str | None, float]],
    epochs: int = 1, seed: int = 0, text: str = "text",
) -> DataFrame:
    """``docs`` with ``domain``, ``tokens``, ``epoch`` and ``budget``: the rows that the mixture takes, once an epoch.

    Columns of ``docs`` that have these names are replaced.

    The mixture has ``share`` of all tokens, at most ``epochs`` times each document. Within its leaf a document's
    place in an epoch is its hash by seed, epoch and doc_id (ties by token count, then by a hash of the text); the leaf
    takes from its epochs, one after the other, the longest prefix that fits its budget. Null texts count 0 tokens,
    null languages and sources are branches of their own, a null doc_id is hashed by its text. Repeated rows are
    documents of their own. Sums are taken slice by slice of the hash, so a hot leaf is never in one task; only the
    slice in which a budget ends is ordered row by row. What a leaf takes is said by that slice, so the documents
    meet a table of leaves and are not shuffled.
    """
    rows = docs.withColumns({"domain": domain, "tokens": F.coalesce(tokens.cast("long"), F.lit(0))})
    leaves = rows.groupBy(*LEVELS).agg((F.sum("tokens") * float(epochs)).alias("room"))
    total = leaves.agg(F.coalesce(F.sum("room"), F.lit(0.0)).alias("t")).first()["t"]
    due = budgets(leaves, total / epochs * share, weights).withColumnRenamed("budget", "mix__budget")
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(text), F.lit(""))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), named))
    keyed = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("mix__place", place)
    keyed = keyed.withColumn("mix__slice", F.substring("mix__place", 1, DIGITS))
    slices = keyed.groupBy(*LEVELS, "epoch", "mix__slice").agg(F.sum("tokens").alias("mix__sum"))
    run = Window.partitionBy(*LEVELS).orderBy("epoch", "mix__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = joined(slices.withColumn("mix__before", F.coalesce(F.sum("mix__sum").over(run), F.lit(0))), due, LEVELS)
    over = F.when(F.col("mix__before") + F.col("mix__sum") > F.col("mix__budget"), F.struct("epoch", "mix__slice", "mix__before"))
    # of each leaf the slice in which its budget ends; null where it never does
    ends = checkpoint(slices.groupBy(*LEVELS, "mix__budget").agg(F.min(over).alias("mix__end")))
    small = F.broadcast if ends.count() <= BROADCAST_LEAVES else lambda df: df
    placed = joined(keyed, small(ends), LEVELS)
    here, end = F.struct("epoch", "mix__slice"), F.struct("mix__end.epoch", "mix__end.mix__slice")
    whole = placed.where(F.col("mix__end").isNull() | (here < end))
    order = Window.partitionBy(*LEVELS).orderBy("mix__place", "tokens", F.md5(text)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = placed.where(F.col("mix__end").isNotNull() & (here == end))
    last = last.withColumn("mix__upto", F.col("mix__end.mix__before") + F.sum("tokens").over(order)).where("mix__upto <= mix__budget").drop("mix__upto")
    every = whole.unionByName(last).withColumn("budget", F.col("mix__budget"))
    return every.drop("mix__end", "mix__slice", "mix__place", "mix__budget")


#: The production mixture: half of all tokens; the crawl (src0) is one domain, all curated sources the other.
SHARE = 0.5
WEIGHTS = {"domain": {"crawl": 0.3, "curated": 0.7}, "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}}


def domain_of() -> F.Column:
    return F.when(F.col("source").eqNullSafe(F.lit("src0")), F.lit("crawl")).otherwise(F.lit("curated"))


def tokens_of() -> F.Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length("text") / 4)


def op3_mixture(spark, sf_dir: str) -> DataFrame:
    """The documents of the production mixture, at most twice each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    made = mixed(docs, domain_of(), tokens_of(), SHARE, WEIGHTS, epochs=2)
    return made.select("doc_id", "domain", "lang", "source", F.col("epoch").cast("int").alias("epoch"), "tokens", "budget")


def mixture_sql(docs: str, share: float, epochs: int, columns: str) -> str:
    """The same in DuckDB SQL, for the rows of ``docs``."""

    def level(n: int) -> str:
        own, up = ", ".join(LEVELS[:n]), LEVELS[: n - 1]
        part = f"PARTITION BY {', '.join(f'n.{c}' for c in up)}" if up else ""
        weight = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.get(LEVELS[n - 1], {}).items())
        weight = f"CASE {LEVELS[n - 1]} {weight} ELSE 1.0 END" if weight else "1.0"
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM a.{c}" for c in up) or "true"
        return f"""
n{n} AS (SELECT {own}, sum(room) AS room, max(CAST({weight} AS DOUBLE)) AS weight FROM leaves GROUP BY {own}),
s{n} AS (
  SELECT n.*, (a.given - coalesce(sum(n.room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM n{n} n JOIN b{n - 1} a ON {on} WINDOW w AS ({part} ORDER BY n.room / n.weight, {", ".join(f"n.{c}" for c in LEVELS[:n])})
),
b{n} AS (
  SELECT {own}, least(n.room, coalesce(max(CASE WHEN n.room > n.share * n.weight THEN n.share END) OVER ({part}) * n.weight, n.room)) AS given
  FROM s{n} n
),"""

    leaf = " AND ".join(f"r.{c} IS NOT DISTINCT FROM b.{c}" for c in LEVELS)
    return f"""
WITH rows AS (
  SELECT *, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain,
    CAST(coalesce(ceil(strlen(text) / 4.0), 0) AS BIGINT) AS tokens
  FROM {docs}
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS DOUBLE) * {epochs} AS room FROM rows GROUP BY ALL),
b0 AS (SELECT sum(room) / {epochs} * {share} AS given FROM leaves),{"".join(map(level, (1, 2, 3)))}
placed AS (
  SELECT r.*, e.epoch, b.budget,
    sum(r.tokens) OVER (PARTITION BY r.domain, r.lang, r.source ORDER BY e.epoch,
      md5('0:' || e.epoch || ':' || coalesce(CAST(r.doc_id AS VARCHAR), md5(r.text), '')), r.tokens, md5(r.text) ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r CROSS JOIN (SELECT CAST(unnest(range(1, {epochs + 1})) AS INTEGER) AS epoch) e
  JOIN (SELECT domain, lang, source, CAST(floor(given + 1e-6) AS BIGINT) AS budget FROM b3) b ON {leaf}
)
SELECT {columns} FROM placed WHERE upto <= budget
"""


OP3_SQL = mixture_sql("documents", SHARE, 2, "doc_id, domain, lang, source, epoch, tokens, budget")
