"""Pronoun repair of a stream with keyed state: a micro-batch reads and writes the entities that its turns name, not all.

It needs the RocksDB state store (``rocksdb``) and the protobuf package in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convrecall.operators.coref import Memory, _tokens, is_open

FACT = "turn_id int, fact_idx int, subject string, predicate string, object string, text string"
REPAIRED = "conv_id string, turn_id int, fact_idx int, subject string, predicate string, object string, late boolean"
_NAMES = ["turn_id", "fact_idx", "subject", "predicate", "object", "text"]
_SHOWN, _NOW = len(_NAMES), len(_NAMES) + 1  # what came out for a fact before, and what holds now
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Overlay:
    """A map state of one column that is read key by key; changes lie on top of it until ``keep`` writes them."""

    def __init__(self, state):
        self.state, self.now, self.changed = state, {}, set()

    def get(self, key, default=None):
        if key not in self.now:
            self.now[key] = self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None
        return default if self.now[key] is None else self.now[key]

    def __contains__(self, key) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key):
        if key not in self:
            raise KeyError(key)
        return self.now[key]

    def __setitem__(self, key, value) -> None:
        self.now[key] = value
        self.changed.add(key)

    def pop(self, key, default=None):
        found = self.get(key, default)
        self[key] = None
        return found

    def keep(self) -> None:
        for key in self.changed:
            if self.now[key] is not None:
                self.state.updateValue((key,), (self.now[key],))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed = set()


class _Words:
    """Token -> entities: a count for each token, and an entity for each (token, number), so that nothing is rewritten."""

    def __init__(self, counts, members):
        self.counts, self.members, self.added = _Overlay(counts), members, {}

    def add(self, token: str, entity: str) -> None:
        self.added.setdefault(token, []).append(entity)

    def get(self, token: str, default=()) -> list[str]:
        kept = [self.members.getValue((token, i))[0] for i in range(self.counts.get(token, 0))]
        return kept + self.added.get(token, [])

    def keep(self) -> None:
        for token, entities in self.added.items():
            n = self.counts.get(token, 0)
            for i, entity in enumerate(entities):
                self.members.updateValue((token, n + i), (entity,))
            self.counts[token] = n + len(entities)
        self.counts.keep()
        self.added = {}


class _KeyedMemory(Memory):
    """The memory of a conversation over map states; ``keep`` writes what has changed."""

    def __init__(self, states: _Repairs):
        self.head = states.head
        self.alias, self.latest, self.places = (self.head.get() if self.head.exists() else None) or (None, None, 0)
        self.seen, self.place, self.cased = _Overlay(states.seen), _Overlay(states.place), _Overlay(states.cased)
        self.words = _Words(states.counts, states.members)

    def _index(self, entity: str, spelling: str) -> None:
        for token in _tokens(spelling):
            self.words.add(token, entity)

    def keep(self) -> None:
        for part in (self.seen, self.place, self.cased, self.words):
            part.keep()
        self.head.update((self.alias, self.latest, self.places))


class _Repairs(StatefulProcessor):
    """States of a conversation: its entities before its last turn, that turn's facts, and those that wait for a name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "alias string, latest string, places long")
        self.seen = handle.getMapState("seen", "entity string", "turn long")
        self.place = handle.getMapState("place", "entity string", "n long")
        self.cased = handle.getMapState("cased", "entity string", "spelling string")
        self.counts = handle.getMapState("counts", "token string", "n long")
        self.members = handle.getMapState("members", "token string, n long", "entity string")
        self.turn = handle.getListState("turn", f"{FACT}, shown string")
        self.waiting = handle.getListState("waiting", "turn_id int, fact_idx int, predicate string, object string, shown string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))[_NAMES].sort_values(["turn_id", "fact_idx"], kind="stable")
        new = [[*x, None, None] for x in new.itertuples(index=False, name=None)]
        facts = [[*x, None] for x in self.turn.get()]
        last = facts[-1][0] if facts else None
        late = [x for x in new if last is not None and x[0] < last]
        facts += [x for x in new if last is None or x[0] >= last]
        turns = [(turn, list(xs)) for turn, xs in groupby(facts, key=lambda x: x[0])]
        memory, waiting, pending, name, settled = _KeyedMemory(self), [], [], None, False
        for turn, xs in turns:
            if xs is turns[-1][1]:  # it may go on, so what it changes is not kept
                memory.keep()
                pending, settled = list(waiting), name is not None
            for row, (subject, learned) in zip(xs, memory.turn(turn, [tuple(x[2:6]) for x in xs])):
                row[_NOW] = subject
                if learned:
                    name = name or learned
                    for other in waiting:
                        other[_NOW] = learned
                    waiting = []
                if is_open(subject):
                    waiting.append(row)
        out = []
        if name:  # the only case in which those that wait are read
            old = list(self.waiting.get())
            out = [(key[0], x[0], x[1], name, x[2], x[3], False) for x in old if x[4] != name]
            if settled:
                self.waiting.clear()
            elif out:
                self.waiting.put([(*x[:4], name) for x in old])
        if pending:
            self.waiting.appendList([(*x[:2], *x[3:5], x[_NOW]) for x in pending])
        self.turn.put([(*x[:_SHOWN], x[_NOW]) for x in turns[-1][1]])
        out += [(key[0], *x[:2], x[_NOW], *x[3:5], False) for x in facts if x[_NOW] != x[_SHOWN]]
        out += [(key[0], *x[:5], True) for x in late]
        yield pd.DataFrame(out, columns=["conv_id", *_NAMES[:5], "late"])

    def close(self) -> None:
        pass


def stream_repaired_keyed(facts: DataFrame) -> DataFrame:
    """What ``stream_repaired`` gives, with states by entity, token and fact in the place of one text for a conversation.

    Nulls count as there; a null conv_id is a conversation. A micro-batch's own facts of a conversation are sorted in
    memory. Start the stream inside ``rocksdb``.
    """
    number = lambda c, none: F.coalesce(F.col(c).cast("int"), F.lit(none)).alias(c)
    rows = facts.select("conv_id", number("turn_id", -1), number("fact_idx", 0), *_NAMES[2:])
    return rows.groupBy("conv_id").transformWithStateInPandas(_Repairs(), REPAIRED, "update", "None")
