"""A keyword index that is kept between batches: documents with their postings, document frequencies and statistics.

A batch brings documents that are new, changed or gone. It reads the old postings of these alone and appends what they
change: postings as whole rows of a document, frequencies and statistics as differences, which readers add up. So after
any number of batches the index is that of all documents there are, and no batch reads or writes the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from convrecall.functions import text as T
from convrecall.operators.bounded import BLOCK, Blocks, block_lists, dealt_to_blocks
from convrecall.operators.keyword import Index
from convrecall.sources.keyed import KeyedTable
from convrecall.sources.shared import discard, stored

#: A document's postings: its terms in order, with spaces between, and how often each occurs. A fraction of an array of structs.
PACKED = "terms string, counts array<int>"


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def packed(tokens: Column) -> Column:
    """Tokens (without spaces) as a struct of ``length`` and PACKED: they are sorted, and each run is counted by its ends."""

    def counted(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), new)).otherwise(F.array().cast("array<int>"))
        return _let(starts, lambda p: F.struct(
            F.size(s).cast("long").alias("length"), F.array_join(F.transform(p, lambda i: F.get(s, i)), " ").alias("terms"),
            F.transform(p, lambda i, j: F.coalesce(F.get(p, j + 1), F.size(s)) - i).alias("counts"),
        ))

    return _let(F.sort_array(tokens), counted)


def unpacked(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of documents with a row for each of their terms: ``term`` and ``tf``."""
    each = F.inline(F.arrays_zip(F.split("terms", " ").alias("t"), F.col("counts").alias("c"))).alias("term", "tf")
    return docs.where("terms <> ''").select(*columns, each).withColumn("tf", F.col("tf").cast("long"))


@dataclass(frozen=True)
class KeptIndex:
    """The index at ``path``; ``scope`` and ``doc`` are the types of these columns.

    Documents are dealt to buckets by their id as well as their scope, so that one large scope is in all buckets. One
    writer at a time.
    """

    spark: SparkSession
    path: str
    scope: str = "string"
    doc: str = "long"
    buckets: int = 64
    stopwords: tuple[str, ...] = T.STOPWORDS

    def _table(self, name: str, schema: str, key: tuple[str, ...], **also) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/{name}", StructType.fromDDL(schema), key, buckets=self.buckets, **also)

    @cached_property
    def docs(self) -> KeyedTable:
        return self._table("docs", f"scope {self.scope}, doc {self.doc}, at long, length long, {PACKED}", ("scope", "doc"), order="at")

    @cached_property
    def terms(self) -> KeyedTable:
        return self._table("terms", f"scope {self.scope}, term string, df long", ("scope", "term"), sums=("df",))

    @cached_property
    def stats(self) -> KeyedTable:
        return self._table("stats", f"scope {self.scope}, n long, total long", ("scope",), sums=("n", "total"))

    @cached_property
    def heads(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/heads", StructType.fromDDL("name string, version long"), ("name",), buckets=1)

    def update(self, batch: DataFrame, batch_id: int) -> bool:
        """Take a batch (scope, doc, at, text, maybe deleted); false if it was taken before.

        ``at`` tells which version of a document is newer; versions older than the one that is kept change nothing.
        The batch is read several times, and its texts once. Null texts are empty documents. Rows without a scope or a doc are not taken. A batch that is lost half-way may
        be brought again: what it did before is not done twice, and readers see the state before it until all is done.
        """
        if (done := self.heads.taken()) is not None and done >= batch_id:
            return False
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        rows = batch.where("scope is not null and doc is not null").select(
            F.col("scope").cast(self.scope), F.col("doc").cast(self.doc), F.col("at").cast("long"), F.when(~gone, F.coalesce("text", F.lit(""))).alias("text"), gone.alias("gone")
        )
        if not rows.groupBy("scope", "doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # else no text is shuffled
            newest = Window.partitionBy("scope", "doc").orderBy(F.desc_nulls_last("at"), "gone", F.desc_nulls_last("text"))
            rows = rows.withColumn("again", F.row_number().over(newest)).where("again = 1").drop("again")
        fresh = rows.select("scope", "doc", "at", "gone", packed(T.keyword_tokens("text", self.stopwords)).alias("p")).select("scope", "doc", "at", "gone", "p.*")
        there = lambda c: F.when(~F.col("removed"), F.col(c))
        old = self.docs.lookup(rows, "removed").select("scope", "doc", F.col("at").alias("old_at"), there("length").alias("old_length"), there("terms").alias("old"))
        both = stored(fresh.join(old, ["scope", "doc"], "left").where("at >= old_at or old_at is null"))
        each = lambda rows, c, n: rows.where(F.col(c) != "").select("scope", F.explode(F.split(c, " ")).alias("term"), F.lit(n).cast("long").alias("df"))
        change = each(both.where(~F.col("gone")), "terms", 1).unionByName(each(both, "old", -1))
        terms = change.groupBy("scope", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        there, before = (~F.col("gone")).cast("long"), F.col("old").isNotNull().cast("long")
        stats = both.groupBy("scope").agg(
            F.sum(there - before).alias("n"), F.sum(there * F.col("length") - F.coalesce("old_length", F.lit(0))).alias("total")
        )
        self.terms.upsert(terms, batch_id)
        self.stats.upsert(stats, batch_id)
        self.docs.upsert(both, batch_id, "gone", unique=True)  # after what is made of its state before
        self._publish(batch_id)
        discard(both)
        return True

    def _publish(self, batch_id: int, writer: str = "", blocks: int | None = None) -> None:
        """Show readers the tables as they are now, all at once."""
        now = [(name, (getattr(self, name).versions() or [0])[-1]) for name in ("docs", "terms", "stats")]
        now += [("blocks", blocks)] if blocks else []
        self.heads.upsert(self.spark.createDataFrame(now, "name string, version long"), batch_id, writer=writer)

    def _heads(self) -> dict[str, int]:
        return {r["name"]: r["version"] for r in self.heads.read().collect()}

    def open(self) -> Index:
        """The index of all documents there are, as ``bm25_index`` gives it. A scope without documents has no row.

        If blocks were made (``seal``) it has them, and what changed since.
        """
        at = self._heads()

        def table(name: str) -> DataFrame:
            own = getattr(self, name)
            return own.read(at[name]) if at.get(name) else self.spark.createDataFrame([], own.schema)

        docs = table("docs")
        stats = table("stats").where("n > 0").select("scope", "n", (F.col("total") / F.col("n")).alias("avgdl"))
        postings = unpacked(docs.repartition("scope", "doc"), "scope", "doc", "length")  # a document's are in one task, where its scores are summed
        return Index(docs.select("scope", "doc", "length"), postings, table("terms"), stats, self._blocks(at))

    def _folder(self, version: int) -> str:
        return f"{self.path}/blocks/v{version:010d}"

    def _blocks(self, at: dict[str, int]) -> Blocks | None:
        if not at.get("blocks"):
            return None
        changed = self.docs.since(at["blocks"], at["docs"], "gone")
        if changed is None:
            return None  # a table was compacted beside the index: all postings are read until blocks are made again
        lists = self.spark.read.schema(self._lists()).parquet(self._folder(at["blocks"]))
        fresh = unpacked(changed.where("not gone"), "scope", "doc", "length")
        return Blocks(lists, changed.select("scope", "doc"), fresh)

    def _lists(self) -> str:
        return f"scope {self.scope}, term string, block long, most long, least long, list array<struct<doc: {self.doc}, tf: bigint, length: bigint>>"

    def _write_blocks(self, version: int, size: int) -> None:
        dealt = dealt_to_blocks(self.docs.read(version), size)
        rows = block_lists(unpacked(dealt, "scope", "doc", "block", "length")).sortWithinPartitions("scope", "term", "block")
        rows.write.mode("overwrite").parquet(self._folder(version))  # over what a lost writer left

    def seal(self, size: int = BLOCK) -> bool:
        """Write all postings in blocks with bounds, for searches that skip blocks; false if they are up to date.

        Later batches change no block: readers leave their documents out of the blocks and score them beside these, so
        blocks are best made again when much has changed. ``compact`` does so if there are any.
        """
        at = self._heads()
        if not at.get("docs") or at.get("blocks") == at["docs"]:
            return False
        self._write_blocks(at["docs"], size)
        self.heads.upsert(self.spark.createDataFrame([("blocks", at["docs"])], "name string, version long"), (self.heads.taken("seal") or 0) + 1, writer="seal")
        return True

    def compact(self, most: int = 8, size: int = BLOCK) -> int:
        """Merge the folders of buckets that have more than ``most``, and show readers the result; how many buckets there were."""
        made = sum(getattr(self, name).compact(most) for name in ("docs", "terms", "stats"))
        if made:
            blocks, now = self._heads().get("blocks"), self.docs.versions()[-1]
            if blocks and blocks != now:
                self._write_blocks(now, size)
            self._publish((self.heads.taken("compaction") or 0) + 1, "compaction", blocks and now)
        return made

    def vacuum(self) -> int:
        """Delete what the state that readers are shown does not name; how many folders went. Who opened an older state loses it.

        A table that a lost batch has brought further is left alone, and so are documents that changed since blocks were made.
        """
        at = self._heads()
        held = {"docs"} if at.get("blocks") not in (None, at.get("docs")) else set()
        tables = {name: getattr(self, name) for name in ("docs", "terms", "stats") if name not in held}
        return sum(t.vacuum(1) for name, t in tables.items() if t.versions() and t.versions()[-1] == at.get(name))
