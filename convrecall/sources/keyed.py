"""A keyed table of plain files: batches append to the buckets of their keys, readers merge, compaction rewrites buckets.

Rows are dealt to buckets by a hash of some columns. A batch writes its rows, one folder for each bucket it has, and
then a new version of the manifest, which names every folder that counts. A version counts once Spark has marked it as
written, so whatever is lost before that leaves the table as it was, and files that no version names are never read. A
batch is taken once: the manifest holds the number of each writer's last batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, folder string, seq long, batch_id long"
SEQ, GONE, BUCKET = "seq__k", "gone__k", "bucket__k"


@dataclass(frozen=True)
class KeyedTable:
    """The table at ``path``: the newest row of each ``key``.

    ``order`` is the column that tells which row is newer; among equal ones that of the later batch is. ``by`` are the
    columns that buckets are made of (all of ``key`` if not given), so that a batch touches only the buckets of what it has.
    With ``sums`` rows of a key are added up in these columns instead, and keys that come to 0 throughout are gone.
    One writer at a time; readers need no lock, as nothing that a version names is changed.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    order: str | None = None
    by: tuple[str, ...] = ()
    buckets: int = 64
    sums: tuple[str, ...] = ()

    # versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """The versions that were written to their end."""
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/manifest/v*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or ())

    def _manifest(self, version: int | None = None) -> list:
        """Rows of a version, of the newest if none is given: at most a bucket's folders between two compactions, for each bucket."""
        known = self.versions()
        if not known:
            return []
        at = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{at:010d}").collect()

    def _publish(self, rows: list) -> int:
        version = (self.versions() or [0])[-1] + 1
        made = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.path}/manifest/v{version:010d}")  # over what a lost writer left
        return version

    # rows

    def _bucket(self) -> Column:
        own = [F.col(c).cast(self.schema[c].dataType) for c in self.by or self.key]
        return F.pmod(F.xxhash64(*own), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return folder

    def _touched(self, folder: str) -> list[int]:
        fs, path = self._fs()
        return [int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(path(f"{folder}/{BUCKET}=*")) or ()]

    def _raw(self, manifest: list, buckets: set[int] | None = None) -> DataFrame:
        full = StructType([*self.schema.fields]).add(SEQ, "long").add(GONE, "boolean")
        paths = [f"{r.folder}/{BUCKET}={r.bucket}" for r in manifest if r.bucket is not None and (buckets is None or r.bucket in buckets)]
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full).limit(0)

    def _newest(self, manifest: list, buckets: set[int] | None = None) -> DataFrame:
        """One row for each key, tombstones included. A bucket of one folder has no key twice, so its rows are not shuffled."""
        rows = [r for r in manifest if r.bucket is not None and (buckets is None or r.bucket in buckets)]
        n: dict[int, int] = {}
        for r in rows:
            n[r.bucket] = n.get(r.bucket, 0) + 1
        one, more = ([r for r in rows if (n[r.bucket] > 1) == several] for several in (False, True))
        names = [*self.schema.names, SEQ, GONE]
        if not more:
            return self._raw(one).select(*names)
        merged = self._merged(self._raw(more)).select(*names)
        return self._raw(one).select(*names).unionByName(merged) if one else merged

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key, tombstones included."""
        if self.sums:
            added = rows.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in self.sums], F.max(SEQ).alias(SEQ))
            return added.withColumn(GONE, F.array_max(F.array(*[F.abs(F.col(c)) for c in self.sums])) == 0)
        order = [F.desc_nulls_last(c) for c in ([self.order] if self.order else []) + [SEQ]]
        last = Window.partitionBy(*self.key).orderBy(*order, *[F.desc(c) for c in self.schema.names if c not in self.key])
        return rows.withColumn("again__k", F.row_number().over(last)).where("again__k = 1").drop("again__k")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest if none is given; it is empty before the first batch."""
        return self._newest(self._manifest(version)).where(~F.col(GONE)).select(*self.schema.names)

    def lookup(self, keys: DataFrame, gone: str | None = None) -> DataFrame:
        """Rows of the buckets that ``keys`` (the columns that buckets are made of) fall in; other buckets are not read.

        With ``gone``, the name of a boolean column, rows that removed their key come too.
        """
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most one row for each bucket
        return self._shown(self._newest(self._manifest(), touched), gone)

    def _shown(self, rows: DataFrame, gone: str | None) -> DataFrame:
        if gone is None:
            return rows.where(~F.col(GONE)).select(*self.schema.names)
        return rows.select(*self.schema.names, F.col(GONE).alias(gone))

    def since(self, old: int, new: int, gone: str) -> DataFrame | None:
        """The last row of each key that batches after version ``old`` and up to ``new`` brought; ``gone`` tells of removals.

        None if the table was compacted in between, as removals are forgotten then, or if ``old`` is not there any more.
        """
        if old not in self.versions():
            return None
        before, now = ({(r.folder, r.bucket): r for r in self._manifest(v) if r.bucket is not None} for v in (old, new))
        if before.keys() - now.keys():
            return None
        return self._shown(self._newest([r for key, r in now.items() if key not in before]), gone)

    def taken(self, writer: str = "") -> int | None:
        """The number of the last batch that a writer brought."""
        return max((r.batch_id for r in self._manifest() if r.bucket is None and r.folder == writer), default=None)

    def upsert(self, batch: DataFrame, batch_id: int, deleted: str | None = None, writer: str = "", unique: bool = False) -> bool:
        """Take a batch; false, and nothing is changed, if the writer has brought it, or one of a higher number, before.

        Rows whose column ``deleted`` is true remove their key. Repeated keys in a batch are brought to one before they
        are written; with ``unique`` the caller warrants that there are none.
        """
        manifest = self._manifest()
        if any(r.bucket is None and r.folder == writer and r.batch_id >= batch_id for r in manifest):
            return False
        seq = max((r.seq for r in manifest), default=0) + 1
        gone = F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
        own = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows = batch.select(*own, F.lit(seq).cast("long").alias(SEQ), gone.alias(GONE))
        rows = rows if unique and not self.sums else self._merged(rows)
        folder = self._write(rows.select(*self.schema.names, SEQ, GONE).withColumn(BUCKET, self._bucket()))
        kept = [tuple(r) for r in manifest if r.bucket is not None or r.folder != writer]
        self._publish(kept + [(b, folder, seq, None) for b in self._touched(folder)] + [(None, writer, seq, batch_id)])
        return True

    def compact(self, most: int = 8) -> int:
        """Rewrite the buckets of more than ``most`` folders as one, without what is gone; how many were rewritten."""
        manifest = self._manifest()
        folders: dict[int, int] = {}
        for r in manifest:
            if r.bucket is not None:
                folders[r.bucket] = folders.get(r.bucket, 0) + 1
        full = {b for b, n in folders.items() if n > most}
        if not full:
            return 0
        rows = self._newest(manifest, full).where(~F.col(GONE)).select(*self.schema.names, SEQ, GONE)
        folder = self._write(rows.withColumn(BUCKET, self._bucket()))
        seq = max(r.seq for r in manifest)
        kept = [tuple(r) for r in manifest if r.bucket not in full]
        self._publish(kept + [(b, folder, seq, None) for b in self._touched(folder)])
        return len(full)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the newest ``keep`` versions names, and the older versions; how many folders went."""
        fs, path = self._fs()
        known = self.versions()
        named = {r.folder.rpartition("/")[2] for v in known[-keep:] for r in self._manifest(v) if r.bucket is not None}
        gone = [f.getPath() for f in fs.globStatus(path(f"{self.path}/data/*")) or () if f.getPath().getName() not in named]
        for p in gone + [path(f"{self.path}/manifest/v{v:010d}") for v in known[:-keep]]:
            fs.delete(p, True)
        return len(gone)
