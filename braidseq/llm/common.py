"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every operator here reads it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set and Spark is local (tests) one is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (spark.conf.get("spark.checkpoint.dir", None) or context.master.split("[")[0] == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Identifiers that a broadcast may hold at most (16 bytes each, in about 100 MB of hashed relation).
BROADCAST_ROWS = 1_000_000


def only(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids. ids is broadcast only after a count within limit, else both sides shuffle."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is not in ids (null keys stay). ids is broadcast only after a count within limit."""
    ids = settle(ids.select(key).where(F.col(key).isNotNull()).distinct())
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_anti")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the cluster's shared folder and read again."""
    settle(df.limit(0))  # sets the folder where the session has none
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(path: str, spark: SparkSession) -> None:
    """Delete a folder that `written` made, by the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame, nulls_last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """docs as (d, text), d one long for each document that sorts as its doc_id does, and what leads from d back to doc_id (and _text_hash).

    Where every row has a doc_id of its own, d is that and the second is None. Else documents are the distinct pairs of
    doc_id and text: those without a doc_id come first (or last), those of one doc_id in the order of their texts' hashes; rows that
    agree in both are one document given twice. Those are numbered in order by a sort over ranges. A null text is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").take(1):
        return rows.select(F.col("doc_id").alias("d"), "text"), None
    order = [F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    keys = rows.select("doc_id", F.xxhash64("text").alias("text_hash")).distinct().repartitionByRange(shuffle_parts(docs), *order)
    keys = settle(keys.withColumn("part", F.spark_partition_id()))
    sizes = keys.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(before), "part")
    keys = settle(keys.select("doc_id", "text_hash", (F.col("nth") + F.col("before")).alias("d")))
    k = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "d")
    rows = rows.join(k, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("d", "text")
    return rows, keys.select("d", "doc_id", F.col("text_hash").alias("_text_hash"))


def named(results: DataFrame, names: DataFrame | None) -> DataFrame:
    """results with doc_id in place of d."""
    if names is None:
        return results.withColumnRenamed("d", "doc_id")
    return results.join(names, "d").select("doc_id", *[c for c in results.columns if c != "d"])


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _same(a: DataFrame, b: DataFrame) -> bool:
    def digest(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)).alias("h")).first()

    return digest(a) == digest(b)


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 500) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: pairs of longs, in any direction, repeated or not; null ends and loops are ignored.
    Returns (node, component), component the smallest node reachable; only nodes that have an edge appear.
    Rounds go on until no edge changes; if some still do after `rounds`, that is an error.
    Each round is two aggregations and joins in Spark; state is written to the checkpoint folder, never sent to the driver.
    """
    e = settle(
        edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = settle(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        if _same(e, after):
            break
        e = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
