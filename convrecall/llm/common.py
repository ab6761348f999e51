"""What the operators of this subpackage share: reliable checkpoints and distributed connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it names none, local mode gets one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder: smaller than a checkpoint, and columns are read one by one."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names under other ones, and the names that bring them back."""
    back = {f"{c}__aside": c for c in df.columns if c in names}
    return df.withColumnsRenamed({c: a for a, c in back.items()}), back


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Edges (two nodes each) of a graph that one task may hold; its rounds then need no shuffles. Larger ones are distributed.
SMALL_GRAPH = 50_000


def _pairs(*pairs: tuple[str, str], names: tuple[str, str]) -> Column:
    """An array of structs with these names, one for each pair of columns."""
    return F.array(*[F.struct(F.col(p).alias(names[0]), F.col(q).alias(names[1])) for p, q in pairs])


def _lowest_in_place(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with ``m``, the least value of its key: a window shuffles nothing where the rows are in one task."""
    return df.withColumn("m", F.min(value).over(Window.partitionBy(key)))


def _lowest_by_join(df: DataFrame, key: str, value: str) -> DataFrame:
    """The same by a join, which may be split where a key is hot."""
    return df.join(df.groupBy(key).agg(F.min(value).alias("m")), key)


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components of an undirected graph: one row ``(node, component)`` per node that has an edge.

    ``component`` is the smallest node that can be reached. Large-star and small-star steps take turns until the
    edges are a star around every component's smallest node, so the number of rounds grows with the logarithm of
    the size. Minima are combined before they are shuffled; the joins that follow may be split where a hub is hot.
    Nodes may be of any type that can be ordered. Edges with a null end and loops are ignored; repeats are harmless;
    an empty table gives an empty one.
    """
    e = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p is not null and q is not null and p <> q")
    e = checkpoint(e.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        if state[0] <= small:  # stated in each round, as a checkpoint forgets how its rows are dealt
            e, lowest = e.coalesce(1), _lowest_in_place
        else:
            lowest = _lowest_by_join
        seen = state
        both = e.select(F.inline(_pairs(("u", "v"), ("v", "u"), names=("x", "y"))))
        large = lowest(both, "x", "y").where("y > x").select(F.least("m", "x").alias("u"), F.col("y").alias("v")).distinct()
        near = lowest(large, "v", "u")
        e = checkpoint(near.select(F.inline(_pairs(("m", "u"), ("m", "v"), names=("u", "v")))).where("u <> v").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
