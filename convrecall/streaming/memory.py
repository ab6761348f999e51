"""Memory kept current from streams: deduplicated turns, slots with lineage, repaired facts, upserted tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convrecall.functions import text as T
from convrecall.operators.coref import Memory, is_open
from convrecall.operators.kept_index import KeptIndex
from convrecall.operators.keyword import user_turns
from convrecall.operators.vectors import upsert
from convrecall.sources.keyed import KeyedTable

SLOT = "conv_id string, fact_id string, subject string, predicate string, object string, turn_id int, fact_idx int, active boolean, supersedes string"


def stream_docs(turns: DataFrame, watermark: str | None = None) -> DataFrame:
    """User turns, the first of equal texts in each conversation.

    With an event time ``ts`` and a watermark the state of old texts is dropped; without, it has a row for each
    distinct text.
    """
    rows = user_turns(turns)
    if watermark:
        return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["conv_id", "text"])
    return rows.dropDuplicates(["conv_id", "text"])


def stream_slots(facts: DataFrame) -> DataFrame:
    """A row whenever a slot changes: the fact that is current now, and the one it supersedes as inactive.

    Facts of a micro-batch are taken by (turn_id, fact_idx). The state is one fact for each slot; later facts that are
    older than it leave it as it is and come out inactive.
    """
    names = ["conv_id", "fact_id", "subject", "predicate", "object", "turn_id", "fact_idx"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["turn_id", "fact_idx"], kind="stable")
        out = []
        for row in rows[names].itertuples(index=False, name=None):
            row = list(row)
            if now and tuple(row[5:]) < tuple(now[5:]):
                out.append([*row, False, None])
                continue
            if now and now[1] != row[1]:
                out.append([*now, False, None])
            out.append([*row, True, now[1] if now and now[1] != row[1] else None])
            now = row
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=[*names, "active", "supersedes"])

    keyed = facts.select(*names, T.norm_entity("subject").alias("slot_s"), T.norm_entity("predicate").alias("slot_p"))
    state = "conv_id string, fact_id string, subject string, predicate string, object string, turn_id int, fact_idx int"
    return keyed.groupBy("conv_id", "slot_s", "slot_p").applyInPandasWithState(run, SLOT, state, "update", GroupStateTimeout.NoTimeout)


def stream_repaired(facts: DataFrame) -> DataFrame:
    """Facts with repaired subjects in update form: whatever a micro-batch adds or changes in its conversations.

    The state of a conversation is its alias and entities before its last turn, the facts of that turn (which may go
    on in the next micro-batch) and those that still wait for the user's name. Facts of turns before the last one seen
    come out as ``late`` and are not taken up. A null turn_id counts as -1.
    """
    names = ["turn_id", "fact_idx", "subject", "predicate", "object", "text"]
    kinds = [F.coalesce(F.col("turn_id").cast("int"), F.lit(-1)).alias("turn_id"), F.coalesce(F.col("fact_idx").cast("int"), F.lit(0)).alias("fact_idx"), *names[2:]]
    shown, now = len(names), len(names) + 1  # what came out for a fact before, and what holds now

    def advance(memory: Memory, turn: int, rows: list[list], waiting: list[list]) -> list[list]:
        for row, (subject, learned) in zip(rows, memory.turn(turn, [tuple(r[2:6]) for r in rows])):
            row[now] = subject
            if learned:
                for other in waiting:
                    other[now] = learned
                waiting = []
            if is_open(subject):
                waiting = [*waiting, row]
        return waiting

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else {"memory": None, "waiting": [], "rows": []}
        memory, waiting, rows = Memory(old["memory"]), old["waiting"], old["rows"]
        last = rows[-1][0] if rows else None
        new = pd.concat(list(batches)).sort_values(["turn_id", "fact_idx"], kind="stable")[names]
        new = [[*x, None, None] for x in new.itertuples(index=False, name=None)]
        late = [x for x in new if last is not None and x[0] < last]
        rows = rows + [x for x in new if last is None or x[0] >= last]
        facts = [*waiting, *rows]
        turns = [(turn, list(xs)) for turn, xs in groupby(rows, key=lambda x: x[0])]
        for turn, xs in turns[:-1]:
            waiting = advance(memory, turn, xs, waiting)
        before = memory.kept()
        advance(memory, *turns[-1], waiting)
        out = [(key[0], *x[:2], x[now], *x[3:5], False) for x in facts if x[now] != x[shown]]
        out += [(key[0], *x[:5], True) for x in late]
        for x in facts:
            x[shown] = x[now]
        state.update((json.dumps({"memory": before, "waiting": [[*x[:2], "", *x[3:5], "", *x[shown:]] for x in waiting], "rows": turns[-1][1]}),))
        yield pd.DataFrame(out, columns=["conv_id", *names[:5], "late"])

    out = "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, late boolean"
    return facts.select("conv_id", *kinds).groupBy("conv_id").applyInPandasWithState(run, out, "kept string", "update", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a kept table that were written to their end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or ())


def upsert_sink(path: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the table at ``path``: a version for each batch, so replays change nothing.

    A batch starts from the newest version before it, whatever number the first batch has. Each batch writes the whole
    table: this is a sink for tables that are small beside their stream. ``keyed_sink`` is for others.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        old = spark.read.parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write


def keyed_sink(table: KeyedTable, deleted: str | None = None, most: int = 8):
    """A ``foreachBatch`` function that keeps a table of any size: a batch appends to its own buckets, replays change nothing.

    Buckets of more than ``most`` batches are merged as they come up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if table.upsert(batch, batch_id, deleted):
            table.compact(most)

    return write


def index_sink(index: KeptIndex, most: int = 8):
    """A ``foreachBatch`` function that keeps a keyword index of the documents (scope, doc, at, text, maybe deleted)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if index.update(batch, batch_id):
            index.compact(most)

    return write


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there now and give all rows that it put out; a batch that is replayed is written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write)
    started.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").drop("batch")
