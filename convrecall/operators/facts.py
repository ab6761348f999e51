"""Facts: from replies and payloads to rows, validation, and the memory state that follows from their order.

Facts have conv_id, turn_id, fact_idx, subject, predicate, object, confidence and evidence. Their order is
(turn_id, fact_idx) within a conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from convrecall.functions import text as T

ITEM = "array<struct<subject: string, predicate: string, object: string, confidence: double, source_span: string>>"
ORDER = ("turn_id", "fact_idx")
# Fields of a structured payload that are not kept as meta.
OWN_FIELDS = ("subject", "predicate", "object", "confidence", "fact_id", "created_at")


def _items(replies: DataFrame) -> DataFrame:
    rows = F.from_json(T.json_array("reply"), ITEM)
    return replies.select("conv_id", "turn_id", F.posexplode(rows).alias("fact_idx", "x")).select("conv_id", "turn_id", "fact_idx", "x.*")


def parse_replies_plain(replies: DataFrame) -> DataFrame:
    """Facts of replies (conv_id, turn_id, reply) with canonical predicates; incomplete items are left out."""
    rows = _items(replies)
    fields = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "object", "source_span")}
    rows = rows.withColumns(fields).withColumn("predicate", T.canon_predicate("predicate"))
    rows = rows.where("subject <> '' and predicate <> '' and object <> '' and source_span <> ''")
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.85))).withColumnRenamed("source_span", "evidence")


def parse_replies_graph(replies: DataFrame) -> DataFrame:
    """The same by the graph's rules: normal text, predicates in snake case, rows that are not valid facts left out."""
    rows = _items(replies).withColumns({c: T.norm_text(c) for c in ("subject", "object", "source_span")})
    rows = rows.withColumn("predicate", T.snake_like("predicate")).withColumn("confidence", F.coalesce("confidence", F.lit(0.85)))
    return rows.withColumnRenamed("source_span", "evidence").where(valid_fact())


def coerce_payload(payloads: DataFrame) -> DataFrame:
    """Facts of structured payloads (conv_id, turn_id, payload: a JSON array of objects); other keys go to ``meta``.

    A payload with an element that is no object gives no facts at all.
    """
    rows = F.from_json("payload", "array<map<string, string>>")
    fine = rows.isNotNull() & ~F.exists(rows, lambda m: m.isNull())
    items = payloads.where(fine).select("conv_id", "turn_id", F.posexplode(rows).alias("fact_idx", "m"))
    get = lambda k: F.trim(F.coalesce(F.col("m")[k], F.lit("")))
    return items.select(
        "conv_id", "turn_id", "fact_idx", get("subject").alias("subject"), T.canon_predicate(get("predicate")).alias("predicate"),
        get("object").alias("object"), F.coalesce(F.col("m")["confidence"].try_cast("double"), F.lit(0.85)).alias("confidence"),
        F.coalesce(F.col("m")["fact_id"], T.fact_id("conv_id", "turn_id", "fact_idx", get("subject"), get("predicate"), get("object"))).alias("fact_id"),
        F.col("m")["created_at"].alias("created_at"), F.map_filter("m", lambda k, v: ~k.isin(*OWN_FIELDS)).alias("meta"),
    ).where("subject <> '' and predicate <> '' and object <> ''")


def valid_fact() -> Column:
    """Subject, predicate and object are not empty and confidence is within 0 to 1."""
    return F.coalesce(
        (F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "") & F.col("confidence").between(0, 1), F.lit(False)
    )


def split_valid(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and those that are not."""
    return facts.where(valid_fact()), facts.where(~valid_fact())


def make_facts(rows: DataFrame) -> DataFrame:
    """Whole facts of rows that have a subject, a predicate and an object at least; ``split_valid`` parts good from bad.

    Subject, predicate, object and source become normal text (null: empty). What is missing or null gets its default:
    a confidence of 0.85, active, no supersedes and no created_at, an empty ``meta``, and an id that is a hash of the
    source and the fact. Other columns are kept.
    """
    none = F.lit(None).cast("string")
    given = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    made = rows.withColumns({c: T.norm_text(given(c, none)) for c in ("subject", "predicate", "object", "source")})
    empty = F.create_map().cast("map<string, string>")
    return made.withColumns({
        "fact_id": F.coalesce(F.nullif(given("fact_id", none), F.lit("")), T.fact_id("source", "subject", "predicate", "object")),
        "confidence": given("confidence", F.lit(0.85)).cast("double"), "active": given("active", F.lit(True)),
        "supersedes": given("supersedes", none), "created_at": given("created_at", none), "meta": given("meta", empty),
    })


def valid_chunk(dim: int | None = None) -> Column:
    """Id and text are not empty; an embedding, if there is one, is of numbers and of the dimension asked for."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    fine = fine & (F.size(v) == dim) if dim else fine
    return (F.coalesce(F.col("chunk_id"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "") & (v.isNull() | fine)


def chunks(facts: DataFrame) -> DataFrame:
    """A chunk of each fact: its text and, as ``meta``, what it was made from and its state, as far as it is known."""
    meta = ("conv_id", "fact_id", "subject", "predicate", "object", "confidence", "evidence")
    meta += tuple(c for c in ("created_at", "active", "supersedes") if c in facts.columns)
    pairs = [x for c in meta for x in (F.lit(c), F.col(c).cast("string"))]
    return facts.select(
        F.concat(F.lit("chunk_"), F.substring(F.sha2(F.col("fact_id"), 256), 1, 12)).alias("chunk_id"),
        T.fact_text("subject", "predicate", "object").alias("text"), "conv_id", "turn_id", F.create_map(F.lit("type"), F.lit("fact"), *pairs).alias("meta"),
    )


def extract_facts(turns: DataFrame, extractor: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Replies (conv_id, turn_id, reply) of any vectorised function from texts to replies, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["conv_id", "turn_id"]].assign(reply=extractor(batch["text"]))

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "turn_id", "text").mapInPandas(run, f"conv_id {kind}, turn_id int, reply string")


def _names() -> Column:
    """The name that a fact gives, null where it gives none or a blank one."""
    return F.when(F.col("predicate") == "name", F.nullif(F.trim("object"), F.lit("")))


def forward_alias(facts: DataFrame) -> DataFrame:
    """First-person subjects take the latest name given before them in the conversation; nothing is rewritten. Blank names give none."""
    before = Window.partitionBy("conv_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    alias = F.last(_names(), ignorenulls=True).over(before)
    first = F.lower(F.trim("subject")).isin(*T.FIRST_PERSON)
    return facts.withColumn("alias", alias).withColumn("subject", F.when(first & F.col("alias").isNotNull(), F.col("alias")).otherwise(F.col("subject"))).drop("alias")


def retroactive_alias(facts: DataFrame) -> DataFrame:
    """First-person subjects take the name known as of their fact, else the first that the conversation gives at all.

    A name that differs from the one known only in case leaves it as it is: the first spelling stays until another
    name comes. Blank names give none.
    """
    mine = Window.partitionBy("conv_id").orderBy(*ORDER)
    before, upto = mine.rowsBetween(Window.unboundedPreceding, -1), mine.rowsBetween(Window.unboundedPreceding, 0)
    every = mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = facts.withColumn("name__a", _names())
    rows = rows.withColumn("last__a", F.last("name__a", ignorenulls=True).over(before))
    # repeats of the name before, in whatever case, are no new name, so what is left are the spellings that stay
    rows = rows.withColumn("name__a", F.when(F.lower("name__a").eqNullSafe(F.lower("last__a")), F.lit(None)).otherwise(F.col("name__a")))
    alias = F.coalesce(F.last("name__a", ignorenulls=True).over(upto), F.first("name__a", ignorenulls=True).over(every))
    rows = rows.withColumn("alias__a", alias)
    return rows.withColumn("subject", T.canon_subject(F.col("subject"), F.col("alias__a"))).drop("name__a", "last__a", "alias__a")


def slot_states(facts: DataFrame, scope: str = "conv") -> DataFrame:
    """Each fact with ``active``, ``supersedes`` and ``valid_to``: in a slot (subject, predicate) the newest is active.

    Slots are of a conversation, or of all (``scope='global'``, ordered by ``ingest_seq`` first). Of rows with one
    fact_id in a slot the last replaces the others. Deterministic for every order of the input.
    """
    order = ORDER if scope == "conv" else ("ingest_seq", *ORDER)
    keyed = facts.withColumns({"slot_s": T.norm_entity("subject"), "slot_p": T.norm_entity("predicate")})
    slot = (["conv_id"] if scope == "conv" else []) + ["slot_s", "slot_p"]
    last = Window.partitionBy(*slot, "fact_id").orderBy(*[F.desc(c) for c in order])
    keyed = keyed.withColumn("again", F.row_number().over(last)).where("again = 1").drop("again")
    if scope == "global":
        return _stitched(keyed, slot, order).drop("slot_s", "slot_p")
    w = Window.partitionBy(*slot).orderBy(*order)
    return keyed.withColumns({
        "active": F.lead("fact_id").over(w).isNull(), "supersedes": F.lag("fact_id").over(w), "valid_to": F.lead("turn_id").over(w),
    }).drop("slot_s", "slot_p")


def _stitched(keyed: DataFrame, slot: list[str], order: tuple[str, ...]) -> DataFrame:
    """The lineage of slots of any size: linked within ranges of ``order[0]``, and the ranges stitched together.

    Ranges are cut at quantiles, as many as there are shuffle partitions, so a task holds a slot's facts of one range.
    What meets beyond that are each range's first and last fact of the slot.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.select(F.percentile_approx(order[0], [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]), lambda c: c <= F.col(order[0])))
    keyed = keyed.withColumn("range__s", F.when(F.col(order[0]).isNull(), 0).otherwise(at))
    own = Window.partitionBy("range__s", *slot).orderBy(*order)
    here = F.struct("fact_id", "turn_id")
    keyed = keyed.withColumns({"prev__s": F.lag("fact_id").over(own), "next__s": F.lead(here).over(own)})
    ends = keyed.groupBy("range__s", *slot).agg(
        F.max(F.when(F.col("prev__s").isNull(), here)).alias("first__s"), F.max(F.when(F.col("next__s").isNull(), F.col("fact_id"))).alias("last__s")
    )
    whole = Window.partitionBy(*slot).orderBy("range__s")  # a row for each range
    ends = ends.select("range__s", *slot, F.lag("last__s").over(whole).alias("before__s"), F.lead("first__s").over(whole).alias("after__s"))
    after = F.coalesce("next__s", "after__s")
    return keyed.join(ends, ["range__s", *slot]).withColumns({
        "active": after.isNull(), "supersedes": F.coalesce("prev__s", "before__s"), "valid_to": after["turn_id"],
    }).drop("range__s", "prev__s", "next__s", "before__s", "after__s")


def latest_global(facts: DataFrame) -> DataFrame:
    """The current fact of each global slot without a sort of the whole slot: the latest by conversation, then of those."""
    key = [T.norm_entity("subject").alias("slot_s"), T.norm_entity("predicate").alias("slot_p")]
    row = F.struct("ingest_seq", *ORDER, "fact_id", "conv_id", "subject", "predicate", "object").alias("f")
    near = facts.groupBy("conv_id", *key).agg(F.max(row).alias("f"))
    return near.groupBy("slot_s", "slot_p").agg(F.max("f").alias("f")).select("f.*")


def as_of(states: DataFrame, moments: DataFrame) -> DataFrame:
    """Facts that are current at each moment (qid, conv_id, at): known by then and not yet replaced.

    The span of turns that moments ask for is halved again and again into cells. A fact's time is cut into the fewest
    cells that make it up, two of a size at most, and a moment lies in one cell of each size; so facts and moments meet by
    equality, each pair once. A fact without a turn is never current, a moment without ``at`` has no facts.
    """
    low, high = moments.select(F.min("at"), F.max("at")).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    levels = max(1, (high - low + 1).bit_length())
    begin = F.greatest(F.col("turn_id").cast("long") - low, F.lit(0))
    end = F.least(F.coalesce(F.col("valid_to").cast("long"), F.lit(high + 1)) - low, F.lit(high - low + 1))
    none = F.array().cast("array<struct<level: int, cell: bigint>>")
    cell = lambda level, x: F.array(F.struct(level.alias("level"), x.alias("cell")))

    def halve(acc: Column, level: Column) -> Column:
        """Cells of this size at the two ends; what is left is counted in cells of twice the size."""
        l, r = acc["l"], acc["r"]
        left, right = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
        r_left = (l + 1 < r) | (l % 2 == 0)  # an odd cell may be both ends
        cells = F.concat(acc["cells"], F.when(left, cell(level, l)).otherwise(none), F.when(right & r_left, cell(level, r - 1)).otherwise(none))
        return F.struct(F.floor((l + 1) / 2).alias("l"), F.floor(r / 2).alias("r"), cells.alias("cells"))

    start = F.struct(begin.alias("l"), end.alias("r"), none.alias("cells"))
    spans = states.where("turn_id is not null").withColumn("x__a", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, halve)["cells"]))
    spans = spans.withColumns({"level__a": F.col("x__a.level"), "cell__a": F.col("x__a.cell"), "conv__a": F.col("conv_id")}).drop("x__a", "conv_id")
    asked = moments.where("at is not null").withColumn("level__m", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    asked = asked.withColumn("cell__m", F.floor((F.col("at").cast("long") - low) / F.pow(F.lit(2), F.col("level__m"))))
    on = F.expr("conv_id = conv__a and level__m = level__a and cell__m = cell__a")
    return asked.join(spans, on).drop("conv__a", "level__a", "cell__a", "level__m", "cell__m")


def entity_timeline(facts: DataFrame) -> DataFrame:
    """The last turn of each entity (lower case) that is a subject or object in a conversation."""
    rows = facts.select("conv_id", "turn_id", F.explode(F.array("subject", "object")).alias("entity"))
    return rows.groupBy("conv_id", F.lower("entity").alias("entity")).agg(F.max("turn_id").alias("last_turn"))
