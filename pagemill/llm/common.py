"""What several operators of this subpackage share: checkpoints, exact components, row identity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor can read.

    Only where spark.checkpoint.dir is not set, as in tests on one machine, a temporary one is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and cut off from how they were made."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed, but as a table of compressed columns; for wide or long results. `dropped` removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what `stored` wrote; nothing may read it after."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def repeat(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column `copies` says; the column goes."""
    return df.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop(copies)


def attached(rows: DataFrame, values: DataFrame, key: str, copies: str, most: int = 4096) -> DataFrame:
    """rows, many for a key, joined with values, one for each key with its number of rows in `copies` (which goes).

    A key with over 1/most of all rows would meet in one task. There are fewer than `most` such keys, so their values
    are broadcast; the others are joined by shuffles. Both tables should be stored ones, as they are read twice.
    """
    total = values.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    hot = F.col(copies) * most > total
    many = F.broadcast(values.where(hot).drop(copies))
    few = rows.join(F.broadcast(values.where(hot).select(key)), key, "left_anti").join(values.where(~hot).drop(copies), key)
    return rows.join(many, key).unionByName(few)


def components(edges: DataFrame) -> DataFrame:
    """Exact connected components of undirected edges (a, b: long): rows (node, root), root the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of a chain's length. All state is
    checkpointed tables of one row a node; both sides of each join come from a table, so a hub's
    rows can be split between tasks. Empty edges give no rows; loops and repeats change nothing.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    state = None
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        hooked = checkpointed(labels.join(near, "node").select("node", F.least("root", "near").alias("root")))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = checkpointed(hooked.join(up, "root").select("node", F.col("top").alias("root")))
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return labels
        state = now
