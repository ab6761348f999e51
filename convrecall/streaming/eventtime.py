"""Streams in event time: rows once each, those that come too late in a stream of their own, state that is let go.

The watermark before a batch is the latest event time of the batches before it, less a delay. Rows behind it are late.
Of the others the first of each key goes on, unless the key was seen before; keys behind the watermark are let go, as
only late rows could repeat them. Everything is kept in tables in the shared folder, so that a batch that is brought
again gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from convrecall.sources.keyed import KeyedTable


@dataclass(frozen=True)
class EventTime:
    """Deduplication of a stream with columns ``key`` and the event time ``ts``, with results and state under ``path``.

    ``schema`` is that of the stream and ``ties`` the columns that order rows of one key and time.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    ts: str
    delay_s: int
    ties: tuple[str, ...] = ()
    buckets: int = 64

    @cached_property
    def seen(self) -> KeyedTable:
        kinds = StructType([self.schema[c] for c in self.key]).add("at__e", "timestamp").add("batch__e", "long")
        return KeyedTable(self.spark, f"{self.path}/seen", kinds, self.key, "at__e", buckets=self.buckets)

    @cached_property
    def marks(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/marks", StructType().add("batch", "long").add("latest", "timestamp"), ("batch",), buckets=1)

    def watermark(self, batch_id: int):
        """The watermark before a batch, null before the first."""
        return self.marks.read().where(F.col("batch") < batch_id).agg((F.max("latest") - F.expr(f"interval {self.delay_s} seconds")).alias("w")).first()["w"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` function. Rows without a time are late, rows with a null in their key are like any other."""
        mark = self.watermark(batch_id)
        behind = F.col(self.ts).isNull() if mark is None else F.col(self.ts).isNull() | (F.col(self.ts) < F.lit(mark))
        batch = batch.select(*self.schema.names)
        batch.where(behind).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        first = Window.partitionBy(*self.key).orderBy(self.ts, *self.ties, *[c for c in self.schema.names if c not in (self.ts, *self.ties)])
        new = batch.where(~behind).withColumn("again__e", F.row_number().over(first)).where("again__e = 1").drop("again__e")
        known = self.seen.lookup(new).where(F.col("batch__e") != batch_id)  # what this batch left before it was lost is not known
        if mark is not None:
            known = known.where(F.col("at__e") >= F.lit(mark))
        known = known.select(*[F.col(c).alias(f"{c}__e") for c in self.key])
        on = F.lit(True)
        for c in self.key:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}__e"))
        new.join(known, on, "left_anti").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        fresh = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={batch_id}")
        self.seen.upsert(fresh.select(*self.key, F.col(self.ts).alias("at__e"), F.lit(batch_id).alias("batch__e")), batch_id)
        self.seen.compact(8)
        self.marks.upsert(batch.agg(F.lit(batch_id).alias("batch"), F.max(self.ts).alias("latest")), batch_id)
        self.marks.compact(64)

    def rows(self) -> DataFrame:
        """What went on, with the batch it came in."""
        return self._read("rows")

    def late(self) -> DataFrame:
        """What came too late, with the batch it came in."""
        return self._read("late")

    def _read(self, name: str) -> DataFrame:
        full = StructType([*self.schema.fields]).add("batch", "long")
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
