"""Removal of long repeated byte strings by sparse suffix sorting.

Suffixes are sampled by content: of the keys (hashed strings of KEY bytes) in each window of ``length`` bytes the least
marks an anchor, so that equal windows have equal anchors at equal offsets. Only anchors whose key is repeated go on.
Anchors whose whole surroundings are repeated are settled by counting. For the others, one of each kind of
surroundings, the suffixes that follow equal keys are ordered by deep-shallow sorting: multikey quicksort to a shallow
depth, then blind tries. Common prefixes of neighbours, taken down a blind trie of what precedes the keys, tell which
windows of ``length`` bytes occur elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from convrecall.llm.common import checkpoint, discard, stored

#: Length of a repeated string that is removed, and of the keys that mark anchors.
LENGTH = 400
KEY = 200
#: Bytes that are hashed at a time.
CHUNK = 1 << 19
#: Multikey quicksort goes so deep, by words of so many bytes; blind tries do the rest.
SHALLOW = 32
WORD = 8
#: Kinds of surroundings that a task orders at a time. Those of a key with more are dealt out by what they have in common.
GROUP = 50_000

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _slide(f: np.ufunc, x: np.ndarray, width: int, fill: int) -> np.ndarray:
    """f (minimum or maximum) of every ``width`` neighbours: each window is a block's tail and the next one's head."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, fill, x.dtype)]).reshape(-1, width)
    heads = f.accumulate(blocks, axis=1).ravel()
    tails = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(tails[: n - width + 1], heads[width - 1 : n])


class Sampler:
    """Anchors of texts."""

    def __init__(self, length: int = LENGTH, key: int = KEY):
        self.length, self.key, self.width = length, key, length - key + 1
        n = 2 * CHUNK + 2 * length
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def _marked(self, buf: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Positions of the anchors of texts that lie one behind the other and end at ``stops``."""
        n, zero = len(buf), np.uint64(0)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[buf] * self.up[:n], out=sums[1:])
        h = (sums[self.key :] - sums[: -self.key]) * self.down[: n - self.key + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)
        least = _slide(np.minimum, h, self.width, int(~zero))
        over = np.zeros(n + 1, np.int32)  # windows that reach over the end of a text don't count
        np.add.at(over, stops - self.length + 1, 1)
        np.add.at(over, stops, -1)
        least[np.cumsum(over)[: len(least)] > 0] = zero
        pad = np.zeros(self.width - 1, np.uint64)
        return np.flatnonzero(_slide(np.maximum, np.concatenate([pad, least, pad]), self.width, 0) == h)

    def anchors(self, texts: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Index of each text of at least ``length`` bytes and the positions of its anchors."""
        parts: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[tuple[int, int, list[int]]]:
            sizes = np.array([len(b) for _, _, b in parts])
            stops = np.cumsum(sizes)
            at = self._marked(np.frombuffer(b"".join(b for _, _, b in parts), np.uint8), stops)
            cuts = np.searchsorted(at, stops).tolist()
            for (i, base, b), lo, hi, stop in zip(parts, [0, *cuts], cuts, stops.tolist()):
                yield i, base, (at[lo:hi] - (stop - len(b)) + base).tolist()

        def found() -> Iterator[tuple[int, int, list[int]]]:
            nonlocal size
            for i, text in enumerate(texts):
                for base in range(0, max(0, len(text) - self.length + 1), CHUNK):
                    part = text[base : base + CHUNK + self.length - 1]  # so many windows; a long text in parts
                    parts.append((i, base, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield from flush()
                        parts.clear()
                        size = 0
            if parts:
                yield from flush()

        last, own = -1, []
        for i, base, at in found():
            if i != last:
                if own:
                    yield last, own
                last, own = i, at
            else:
                own = sorted({*own, *at})
        if own:
            yield last, own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_order(strings: list[bytes], rows: list[int]) -> list[int]:
    """Rows in the order of their strings, by insertion into a blind trie: inner nodes know a depth and first bytes only."""
    root: list | None = None  # a leaf is [rows]; an inner node is [depth, {byte: node}]

    def leaf(node: list) -> list[int]:
        while len(node) == 2:
            node = next(iter(node[1].values()))
        return node[0]

    for i in rows:
        s = strings[i]
        if root is None:
            root = [[i]]
            continue
        node = root
        while len(node) == 2:
            after = node[1].get(s[node[0]] if len(s) > node[0] else -1)
            if after is None:
                break
            node = after
        other = strings[leaf(node)[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            leaf(node).append(i)
            continue
        own = s[depth] if len(s) > depth else -1
        up, node = None, root
        while len(node) == 2 and node[0] < depth:
            up, node = node, node[1][s[node[0]]]
        if len(node) == 2 and node[0] == depth:
            node[1][own] = [[i]]
            continue
        split = [depth, {other[depth] if len(other) > depth else -1: node, own: [[i]]}]
        if up is None:
            root = split
        else:
            up[1][s[up[0]]] = split
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if len(node) == 2:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node[0])
    return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Indexes of strings in their order: multikey quicksort to SHALLOW bytes, blind tries for what is still equal."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out += rows
        elif depth >= SHALLOW:
            out += blind_order(strings, rows)
        else:
            words = [strings[i][depth : depth + WORD] for i in rows]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(rows, words) if w < pivot]
            same = [i for i, w in zip(rows, words) if w == pivot]
            more = [i for i, w in zip(rows, words) if w > pivot]
            stack += [(more, depth), (same, depth + WORD if len(pivot) == WORD else SHALLOW), (less, depth)]
    return out


def repeated(befores: list[bytes], afters: list[bytes], room: int) -> Iterator[tuple[int, int, int]]:
    """``(i, least, most)``: windows that begin ``least`` to ``most`` bytes before key i occur at another key too.

    ``befores`` hold what precedes equal keys, backwards, ``afters`` what follows, each up to ``room`` bytes. Such a
    window holds the key, d bytes before it and ``room`` - d bytes after it.
    """
    stack = [deep_shallow_order(afters)]
    while stack:
        rows = stack.pop()
        own = [befores[i] for i in rows]
        depth = common(min(own), max(own))
        near = [0, *(common(afters[i], afters[j]) for i, j in zip(rows, rows[1:])), 0]
        for i, a, b in zip(rows, near, near[1:]):
            least = room - max(a, b)
            if least <= depth:
                yield i, least, depth
        if depth < room:
            below: dict[int, list[int]] = {}
            for i, s in zip(rows, own):
                if len(s) > depth:
                    below.setdefault(s[depth], []).append(i)
            stack.extend(x for x in below.values() if len(x) > 1)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def anchors(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """``(doc_id, row, pos, key, around)`` of every anchor: hashes of the key and of all within reach of its windows."""
    room = length - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, digest = Sampler(length, key), xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = _texts(batch.column(2))
            which, pos, keys, around = [], [], [], []
            for i, at in sampler.anchors(texts):
                b = texts[i]
                which += [i] * len(at)
                pos += at
                keys += [digest(b[a : a + key]) for a in at]
                around += [digest(b[max(0, a - room) : a + length], min(a, room)) for a in at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(which, pa.int64())) for i in (0, 1)),
                    pa.array(pos, pa.int32()),
                    *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, around)),
                ],
                ["doc_id", "row", "pos", "key", "around"],
            )

    return docs.mapInArrow(run, "doc_id long, row long, pos int, key long, around long")


def marks(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(doc_id, row, settled, at): of each text with repeated keys, the anchors that counting settles and those to order.

    ``settled`` are positions whose whole surroundings occur elsewhere too. ``at`` has, of each kind of surroundings
    under a key that has several kinds and some single one, one anchor: (pos, open: it is the only one, kinds). Rows
    alike in doc_id and text have one result. Kinds are counted where they are before they are shuffled, and no step
    needs all anchors of a key in one task.
    """
    every = stored(anchors(docs, length, key))
    # a table of its own: what joins two shuffles and nothing else can be split where a key is hot
    often = stored(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    live = stored(every.join(often, "key"))
    discard(every)
    discard(often)
    # as a struct, for a grouping by key and around would keep a join's partitions by key, hot ones and all
    live = live.select("doc_id", "row", "pos", F.struct("key", "around").alias("kind"), F.xxhash64("doc_id", "row", "pos").alias("place"))
    kinds = live.groupBy("kind").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    mixed = kinds.groupBy(F.col("kind.key").alias("key")).agg(F.count("*").alias("kinds"), (F.min("n") == 1).alias("single"))
    known = kinds.withColumn("key", F.col("kind.key")).join(mixed, "key")
    known = known.select("kind", "n", "kinds", F.when(F.expr("single and kinds > 1"), F.col("first")).alias("first")).where("n > 1 or first is not null")
    named = live.join(known, "kind").withColumn("order", F.col("place").eqNullSafe(F.col("first"))).where("n > 1 or order")
    return named.groupBy("doc_id", "row").agg(
        F.collect_set(F.when(F.col("n") > 1, F.col("pos"))).alias("settled"),
        F.collect_set(F.when(F.col("order"), F.struct("pos", (F.col("n") == 1).alias("open"), "kinds"))).alias("at"),
    )


def _surroundings(docs: DataFrame, found: DataFrame, length: int, key: int) -> DataFrame:
    """Pieces: what precedes and follows the keys of the anchors ``at`` of the ``marks``, under 128 bits of the key's hash."""
    room = length - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            which, rows = [], []
            for i, places in enumerate(batch.column(3).to_pylist()):
                own = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if own == last:  # rows alike follow each other after the join
                    continue
                last, b = own, batch.column(2)[i].cast(pa.binary()).as_py()
                for x in places:
                    a = x["pos"]
                    group = xxhash.xxh3_128_digest(b[a : a + key])
                    rows.append((group, a, x["open"], x["kinds"], b[max(0, a - room) : a][::-1], b[a + key : a + length]))
                which += [i] * len(places)
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(which, pa.int64())) for i in (0, 1)),
                    *(pa.array(c, k) for c, k in zip(cols, kinds)),
                ],
                ["doc_id", "row", "group", "pos", "open", "kinds", "before", "after"],
            )

    joined = docs.join(found.where("size(at) > 0").select("doc_id", "row", "at"), ["doc_id", "row"]).select("doc_id", "row", "text", "at")
    return joined.mapInArrow(
        run, "doc_id long, row long, group binary, pos int, open boolean, kinds long, before binary, after binary"
    )


def _ordered(pieces: DataFrame, length: int, key: int) -> DataFrame:
    """Spans ``(doc_id, row, lo, hi)`` found by ordering the pieces of each group; a task streams its groups one by one."""
    room = length - key

    def solve(group: list[tuple]) -> Iterator[tuple]:
        if len(group) > 1 and any(x[3] for x in group):
            for i, least, most in repeated([x[4] for x in group], [x[5] for x in group], room):
                doc, row, pos, still = group[i][:4]
                if still:
                    yield doc, row, pos - most, pos - least + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "row", "lo", "hi"])

        now, group = None, []
        for batch in batches:
            made: list[tuple] = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    made.extend(solve(group))
                    now, group = k, []
                group.append(rest)
            yield out(made)
        yield out(list(solve(group)))

    rows = pieces.select("group", "doc_id", "row", "pos", "open", "before", "after")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "doc_id long, row long, lo int, hi int")


def _dealt(pieces: DataFrame, length: int, key: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Groups of at most ``most`` pieces, and spans, of the pieces of groups with more.

    Two pieces share a window if the bytes they have in common before and after the key come to ``room``. Of what is
    still wanting beyond the ``p`` and ``q`` bytes that a group has in common before and after, they then share one half
    before or the other after. So a group is dealt out by the bytes of that half on either side, again and again, until
    groups are small, or have a window in common.
    """
    room = length - key
    wanting = F.lit(room) - F.col("p") - F.col("q")
    ahead = F.ceil(wanting / 2).cast("int")
    rest = (wanting + 1 - ahead).cast("int")
    level = pieces.drop("kinds").withColumns({"p": F.lit(0), "q": F.lit(0)})
    spans, ready = None, None
    while True:
        side = lambda name, c, at, n, p, q: F.when(
            F.octet_length(c) >= at + n,
            F.struct(F.unhex(F.md5(F.concat("group", F.lit(name), F.substring(c, at + 1, n)))).alias("group"), p.alias("p"), q.alias("q")),
        )
        p, q = F.col("p"), F.col("q")
        sides = F.array(side(b"b", F.col("before"), p, ahead, p + ahead, q), side(b"a", F.col("after"), q, rest, p, q + rest))
        level = level.withColumn("x", F.explode(sides)).where("x is not null").select("doc_id", "row", "pos", "open", "before", "after", "x.*")
        sizes = level.groupBy("group").agg(F.count("*").alias("n"), F.bool_or("open").alias("some")).where("n > 1 and some").drop("some")
        level = checkpoint(level.join(sizes, "group"))
        done = level.where(wanting <= 0)
        found = done.where("open").select("doc_id", "row", (F.col("pos") - F.col("p")).alias("lo"), (F.col("pos") - F.col("p") + length).alias("hi"))
        small = level.where((wanting > 0) & (F.col("n") <= most)).drop("n", "p", "q")
        spans, ready = (found, small) if spans is None else (spans.unionByName(found), ready.unionByName(small))
        level = level.where((wanting > 0) & (F.col("n") > most)).drop("n")
        if level.isEmpty():
            return ready, spans


def spans(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP) -> DataFrame:
    """``(doc_id, row, lo, hi)``: bytes lo to hi of the text are covered by strings of ``length`` bytes found elsewhere.

    ``docs`` has doc_id, row (a hash of doc_id and text) and text. Spans of a text may overlap, and may reach over its
    end where all to the end is covered.
    """
    found = checkpoint(marks(docs, length, key))
    settled = found.select("doc_id", "row", F.explode("settled").alias("pos")).select(
        "doc_id", "row", F.greatest(F.col("pos") - (length - key), F.lit(0)).alias("lo"), (F.col("pos") + length).alias("hi")
    )
    pieces = _surroundings(docs, found, length, key)
    large = found.where(F.exists("at", lambda x: x["kinds"] > group))
    if large.isEmpty():
        return settled.unionByName(_ordered(pieces, length, key))
    parts, more = _dealt(checkpoint(_surroundings(docs, large, length, key).where(F.col("kinds") > group)), length, key, group)
    small = pieces.where(F.col("kinds") <= group).drop("kinds").unionByName(parts)
    return settled.unionByName(_ordered(small, length, key)).unionByName(more)


def _runs(cuts: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi) of the maximal runs that the cuts of each text cover, in order."""
    flat = cuts.flatten()
    n = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False)
    which = np.repeat(np.arange(len(cuts)), n)
    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    order = np.lexsort((lo, which))
    which, lo, hi = which[order], lo[order], np.minimum(hi[order], sizes[which[order]])
    if not len(lo):
        return which, lo, hi
    shift = which * (int(sizes.max()) + 2)  # texts one behind the other, with a gap
    reach = np.maximum.accumulate(hi + shift)
    first = np.concatenate([[True], (lo + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(lo)]]) - 1
    return which[at], lo[at], reach[last] - shift[at]


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row of ``docs``; ``kept`` is binary.

    Each byte is removed that lies in a string of ``length`` bytes which also starts at any other place of any text.
    All is judged on the input. A null text counts as empty; texts shorter than ``length`` stay as they are; repeated
    rows are texts of their own, so they remove each other. Matches end at the ends of texts. A null doc_id is a
    document like any other. Only ``doc_id`` and ``text`` are read.

    Keys and surroundings are counted by 64 bits each, and by both together: texts are taken for equal that are not
    if two different surroundings of one key agree in 64 bits. What is ordered is compared byte by byte.
    """
    own = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    keyed = own.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "row", "text")
    found = spans(keyed, length, key, group).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cuts = batch.column(2).cast(pa.binary()), batch.column(3)
            sizes = pc.binary_length(raw).to_numpy()
            which, lo, hi = _runs(cuts, sizes)
            ends = np.searchsorted(which, np.arange(len(raw) + 1)).tolist()
            gone = np.bincount(which, hi - lo, len(raw)).astype(np.int64)
            lo, hi = lo.tolist(), hi.tolist()
            kept = []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                text = raw[i].as_py()
                kept.append(b"".join(text[x:y] for x, y in zip([0, *hi[a:b]], [*lo[a:b], len(text)])) if a < b else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone), pa.array(np.diff(ends), pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = keyed.join(found, ["doc_id", "row"], "left").select("doc_id", "row", "text", "cuts")
    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.expr("nullif(doc_id, bigint('-9223372036854775808'))"))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 400 bytes and more that occur elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
