"""JSON objects that stand one behind the other in files without separators, read in byte ranges by many tasks.

Whether a range starts inside a string, and how deep in braces, is known from what stands before it alone. So each range is
first summed up for both cases (inside and outside a string), a window over the few numbers of each range gives the
case that holds, and a second pass reads the objects that begin in the range, the last one to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bytes of a range, and bytes that a task looks at at a time.
RANGE = 1 << 26
PIECE = 1 << 20
#: Bytes that an object may have. A longer one (or one that is never closed) comes out as its first HEAD bytes.
LONGEST = 1 << 28
HEAD = 1 << 16
#: Tasks of a pass, at most; beyond, a task reads several ranges.
TASKS = 20_000
#: What files can be opened in the middle: schemes that pyarrow knows, by their names there, and names that are not compressed.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"

RANGES = "path string, start long, stop long"
SUMS = f"{RANGES}, flips int, rise0 long, low0 long, rise1 long, low1 long"


class Braces:
    """Finds the braces outside strings, piece by piece.

    A quote counts unless an odd number of backslashes stands before it. ``inside`` is 1 inside a string; ``slashes``
    is the number of backslashes that stand right before the next piece.
    """

    def __init__(self, inside: int = 0, slashes: int = 0):
        self.inside, self.slashes = inside, slashes

    def __call__(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the braces, and 1 or -1 for each."""
        b = np.frombuffer(piece, np.uint8)
        others, quotes = np.flatnonzero(b != ord("\\")), np.flatnonzero(b == ord('"'))
        k = np.searchsorted(others, quotes)  # a quote is one of the others
        before = np.where(k > 0, others[k - 1], -1 - self.slashes) if len(k) else k
        real = quotes[(quotes - 1 - before) % 2 == 0]
        at = np.flatnonzero((b == ord("{")) | (b == ord("}")))
        at = at[(np.searchsorted(real, at) + self.inside) % 2 == 0]
        self.inside = (self.inside + len(real)) % 2
        self.slashes = len(b) - 1 - int(others[-1]) if len(others) else self.slashes + len(b)
        return at, np.where(b[at] == ord("{"), 1, -1)


def _open(path: str):
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    return system.open_input_file(inner)


def _slashes(file, at: int) -> int:
    """Backslashes right before a place of a file."""
    n = 0
    while at > n:
        size = min(PIECE, at - n)
        file.seek(at - n - size)
        part = file.read(size)
        own = size - len(part.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n


def _summed(path: str, start: int, stop: int) -> list[int]:
    """Of a range: whether it ends in the other case than it starts; for both cases the depth it adds, and its lowest point."""
    with _open(path) as file:
        slashes = _slashes(file, start)
        scans = [Braces(s, slashes) for s in (0, 1)]
        rise, low = [0, 0], [0, 0]
        file.seek(start)
        for at in range(start, stop, PIECE):
            piece = file.read(min(PIECE, stop - at))
            for s, scan in enumerate(scans):
                steps = np.cumsum(scan(piece)[1])
                if len(steps):
                    low[s] = min(low[s], rise[s] + int(steps.min()))
                    rise[s] += int(steps[-1])
    return [scans[0].inside, rise[0], low[0], rise[1], low[1]]


def objects(pieces: Iterator[bytes], own: int | None = None, depth: int = 0, scan: Braces | None = None, longest: int = LONGEST) -> Iterator[bytes]:
    """The objects that begin in the first ``own`` bytes (None: in all) of the pieces of a text.

    A closing brace that closes nothing is passed over. An object that is longer than ``longest``, or that the text ends
    in, comes out as its first bytes, which are no JSON then.
    """
    scan, at, held, size = scan or Braces(), 0, None, 0
    for piece in pieces:
        if held is None and own is not None and at >= own:
            return
        places, steps = scan(piece)
        level = depth + np.cumsum(steps)
        level -= np.minimum(0, np.minimum.accumulate(level)) if len(level) else 0
        opened = places[(level == 1) & (steps == 1)]
        closed = places[(level == 0) & (steps == -1) & (np.concatenate([[depth], level[:-1]]) == 1)] if len(level) else places
        depth, done = int(level[-1]) if len(level) else depth, 0
        if held is not None:
            end = int(closed[0]) + 1 if len(closed) else len(piece)
            size += end
            held.append(piece[: end if size <= longest else min(end, HEAD)])
            if len(closed):
                yield b"".join(held)[: None if size <= longest else HEAD]
                held, done = None, 1
            elif size > longest:
                yield b"".join(held)[:HEAD]
                if own is not None and at + len(piece) >= own:
                    return
                held, done = None, 0
        elif len(closed) and (not len(opened) or closed[0] < opened[0]):
            done = 1  # the end of an object that began before
        closed = closed[done:]
        for k, begin in enumerate(opened.tolist()):
            if own is not None and at + begin >= own:
                return
            if k < len(closed):
                found = piece[begin : int(closed[k]) + 1]
                yield found if len(found) <= longest else found[:HEAD]
            else:
                held, size = [piece[begin:]], len(piece) - begin
        at += len(piece)
    if held is not None:
        yield b"".join(held)[: None if size <= longest else HEAD]


def _read(path: str, start: int, stop: int, inside: int, depth: int, longest: int) -> Iterator[bytes]:
    with _open(path) as file:
        scan = Braces(inside, _slashes(file, start))
        file.seek(start)
        yield from objects(iter(lambda: file.read(PIECE), b""), stop - start, depth, scan, longest)


def splittable(path: Column) -> Column:
    """Whether a file can be opened in the middle."""
    return F.regexp_extract(path, "^([^:/]+):", 1).isin(*SCHEMES) & ~F.lower(path).rlike(COMPRESSED)


def states(sums: DataFrame) -> DataFrame:
    """``(path, start, stop, inside, depth)`` at the start of each range, from the sums of all ranges of its file.

    The depth never falls below 0: what it would have fallen below by then is added. A window holds a row of numbers for
    each range of a file, so a few bytes for 64 MB.
    """
    along = Window.partitionBy("path").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    own = sums.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    own = own.withColumns({"rise": pick("rise"), "low": pick("low")})
    own = own.withColumn("sum", F.coalesce(F.sum("rise").over(before), F.lit(0)))
    lowest = F.least(F.lit(0), F.coalesce(F.min(F.col("sum") + F.col("low")).over(before), F.lit(0)))
    return own.select("path", "start", "stop", F.col("inside").cast("int").alias("inside"), (F.col("sum") - lowest).alias("depth"))


def read_objects(spark: SparkSession, path: str, range_bytes: int = RANGE, longest: int = LONGEST) -> DataFrame:
    """``value``: the text of each object at the top of each file, of any size of file.

    Files that cannot be opened in the middle (compressed ones, file systems that pyarrow does not know) are read whole,
    by a task each. Text between objects is passed over, so objects of a top-level array come out one by one. Quotes open
    and close strings everywhere; a string that is never closed hides what follows it in its file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").where(splittable(F.col("path")))
    starts = F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)"))
    ranges = files.select("path", starts.alias("start"), "length").select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))
    tasks = max(1, min(TASKS, ranges.count()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*r.values(), *_summed(*r.values())) for r in batch.to_pylist()]
            names = [x.split()[0] for x in SUMS.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                for x in _read(*r.values(), longest):
                    rows.append(x.decode(errors="replace"))
                    size += len(x)
                    if size >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows = [x.decode(errors="replace") for x in objects(iter([text.as_py().encode()]), longest=longest)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    sums = ranges.repartition(tasks).mapInArrow(summed, SUMS)
    split = states(sums).repartition(tasks).mapInArrow(read, "value string")
    rest = spark.read.text(path, wholetext=True).where(~splittable(F.col("_metadata.file_path"))).select("value")
    return split.unionByName(rest.mapInArrow(whole, "value string"))
