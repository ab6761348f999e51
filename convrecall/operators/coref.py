"""Pronoun repair: a fold over each conversation's facts, turn by turn.

It depends on its own results, so a conversation is a stream through one task; what the task keeps of it are its
entities and the turn at hand, not its facts. Names that are learned late are brought back by a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Subjects that point back, and parts of subjects that are vague heads.
PRONOUNS = frozenset(
    "he him his she her hers they them their theirs it its we us our ours i me my myself user <user>".split()
)
VAGUE = ("office", "team", "department", "hq", "headquarters")
FIRST = frozenset("<user> i me my myself user".split())
_TOKEN = re.compile("[A-Za-z0-9]+")


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / max(1, len(a | b))


def _tokens(text: str | None) -> set[str]:
    return {t.lower() for t in _TOKEN.findall(text or "")}


class Memory:
    """What the fold knows of one conversation after some of its turns: the user's name, and entities by recency.

    Recency is the turn of the last mention, then the order of the first one.
    """

    def __init__(self, kept: dict | None = None):
        kept = kept or {"alias": None, "entities": []}
        self.alias: str | None = kept["alias"]
        self.seen: dict[str, int] = {}  # entity -> turn
        self.place: dict[str, int] = {}  # entity -> order of first mention
        self.cased: dict[str, str] = {}
        self.words: dict[str, set[str]] = {}  # token -> entities
        self.places = 0
        for entity, turn, spelling in kept["entities"]:
            self._see(entity, turn)
            if spelling is not None:
                self._spell(entity, spelling)
        self.latest = self._latest(self.seen)

    def kept(self) -> dict:
        """The same as plain values, for a store of states."""
        return {"alias": self.alias, "entities": [(e, self.seen[e], self.cased.get(e)) for e in sorted(self.seen, key=self.place.get)]}

    def _see(self, entity: str, turn: int) -> None:
        if entity not in self.seen:
            self.place[entity] = self.places = self.places + 1
            self._index(entity, entity)
        self.seen[entity] = turn

    def _spell(self, entity: str, spelling: str) -> None:
        if entity not in self.cased:
            self.cased[entity] = spelling
            self._index(entity, spelling)

    def _index(self, entity: str, spelling: str) -> None:
        for token in _tokens(spelling):
            self.words.setdefault(token, set()).add(entity)

    def _recent(self, entities) -> list[str]:
        return sorted(entities, key=lambda e: (-self.seen[e], self.place[e]))

    def _latest(self, entities) -> str | None:
        """The most recent of these entities, as it is spelt."""
        known = [e for e in entities if e in self.seen]
        e = min(known, key=lambda e: (-self.seen[e], self.place[e]), default=None)
        return None if e is None else self.cased.get(e, e)

    def _like(self, text: str | None) -> str | None:
        """The most recent entity that shares enough tokens with a text; only those that share any are looked at."""
        words = _tokens(text)
        some = {e for w in words for e in self.words.get(w, ()) if e in self.seen}
        spelt = (self.cased.get(e, e) for e in self._recent(some))
        return next((e for e in spelt if _overlap(words, _tokens(e)) >= 0.2), None)

    def _canon(self, subject: str) -> str:
        low = subject.strip().lower()
        if low in FIRST:
            return self.alias or "<USER>"
        return self.alias if self.alias and low == self.alias.lower() else subject

    def turn(self, turn: int, rows: list[tuple]) -> list[tuple[str, str | None]]:
        """Take up a turn's facts (subject, predicate, object, text): the repaired subject of each, and the name it gives."""
        repaired, like = [], None
        for subject, *_ in rows:
            subject = subject or ""
            low = subject.strip().lower()
            if low in PRONOUNS:
                subject = self.alias or ("<USER>" if self.latest is None else self.latest)
            elif any(v in low for v in VAGUE):
                like = like or (self._like(rows[0][3]),)
                subject = subject if like[0] is None else like[0]
            repaired.append(self._canon(subject))
        touched = set()
        for subject, row in zip(repaired, rows):
            for entity in (subject, row[2] or ""):
                self._see(entity.lower(), turn)
                touched.add(entity.lower())
        out = []
        for subject, (_, predicate, thing, _) in zip(repaired, rows):
            thing, learned = thing or "", None
            if predicate == "name" and thing.strip():
                name = thing.strip()
                self.alias = learned = self.alias if self.alias and self.alias.lower() == name.lower() else name
                if "<user>" in self.seen:
                    then = self.seen.pop("<user>")
                    self._see(self.alias.lower(), then)
                    touched.add(self.alias.lower())
                self.cased.pop("<user>", None)
            subject = self._canon(subject)
            for entity in (subject, thing):
                self._spell(entity.lower(), entity)
                self._see(entity.lower(), turn)
                touched.add(entity.lower())
            out.append((subject, learned if learned and not is_open(learned) else None))
        self.latest = self._latest(touched)
        return out


def is_open(subject: str) -> bool:
    """Whether a subject still waits for the user's name."""
    return subject.lower() == "<user>"


_READ = ("subject", "predicate", "object", "text")
_NO_TURN = -(1 << 63)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (conv_id, turn_id), each with its repaired subject, the name it gives and its place."""
    memory, conv, waiting, place = Memory(), object(), [], 0

    def turns(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal memory, conv, place
        keys = list(zip(table["conv_id"].to_pylist(), table["turn_id"].to_pylist()))
        rows = list(zip(*[table[c].to_pylist() for c in _READ]))
        made, i = [], 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i][0] != conv:
                memory, conv = Memory(), keys[i][0]
            made += memory.turn(_NO_TURN if keys[i][1] is None else keys[i][1], rows[i:j])
            i = j
        places = pa.array(range(place, place + len(made)), pa.int64())
        place += len(made)
        columns = {"subject__r": pa.array([m[0] for m in made], pa.string()), "learned__r": pa.array([m[1] for m in made], pa.string()), "place__r": places}
        for name, values in columns.items():
            table = table.append_column(name, values)
        yield from table.to_batches(max_chunksize=4096)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        # the last turn may go on in the next batch
        keys = list(zip(batch["conv_id"].to_pylist(), batch["turn_id"].to_pylist()))
        cut = len(keys)
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut:
            yield from turns(pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)]))
            waiting = [batch.slice(cut)]
        elif len(waiting) > 1:
            before = waiting[-2].slice(waiting[-2].num_rows - 1)
            if (before["conv_id"][0].as_py(), before["turn_id"][0].as_py()) != keys[0]:
                yield from turns(pa.Table.from_batches(waiting[:-1]))
                waiting = waiting[-1:]
    if waiting:
        yield from turns(pa.Table.from_batches(waiting))


def repair(facts: DataFrame) -> DataFrame:
    """``facts`` (with ``text``, the turn's) with repaired subjects.

    Pronouns take the alias, else the entity named last (so even a first person does, before any name is known), else
    ``<USER>``. Vague heads take the latest entity that shares enough tokens with the turn's first text. When a name is
    learned, earlier ``<USER>`` facts take it too.

    Facts of a conversation go by (turn_id, fact_idx), ties by their values. Facts without a turn_id are one turn,
    before the others; rows without a conv_id are one conversation. Null subjects become empty ones. An empty table
    gives an empty one.
    """
    order = ("conv_id", "turn_id", "fact_idx", *_READ)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema)
    dealt = facts.repartition("conv_id").sortWithinPartitions(*order)
    folded = dealt.mapInArrow(_folded, f"{kinds}, subject__r string, learned__r string, place__r long")
    # backwards: the last name met is the first that is learned after a fact
    later = Window.partitionBy("conv_id").orderBy(F.desc("place__r")).rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.lower("subject__r") == "<user>", F.last("learned__r", ignorenulls=True).over(later))
    return folded.withColumn("subject", F.coalesce(named, "subject__r")).select(*facts.columns)
