"""Helpers the operators share: durable cuts in the lineage, splits, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors see; beside the warehouse where that is unset and all run in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents no model may learn from: one in five, by the checksum of the id."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} AS string) AS binary)) % 5 = 0"), F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links `(a, b)` as `(node, component)`, the smallest node of each.

    Alternating large and small stars: every round is two grouped minima and two equi-joins over
    the links, which never outnumber those given. Nulls and loops are ignored; a node without a
    link gets no row. Rounds end when the links stop changing.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links, before = checkpoint(links), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if state == before or state[0] == 0:
            break
        before = state
        both = links.selectExpr("hi AS u", "lo AS v").union(links.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        links = checkpoint(
            large.join(small, "hi")
            .select(F.explode(F.expr("array(struct(lo AS hi, m AS lo), struct(hi AS hi, m AS lo))")).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def written(frame: DataFrame) -> str:
    """The path of a new table in the shared folder that holds the rows."""
    path = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4()}"
    frame.write.parquet(path)
    return path


def materialised(frame: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read again: what follows starts from the files, which stay for who reads the result."""
    return frame.sparkSession.read.parquet(written(frame))


@contextmanager
def temporary(frame: DataFrame) -> Iterator[DataFrame]:
    """The same for a table that nothing reads after the block; its files go."""
    spark, path = frame.sparkSession, written(frame)
    try:
        yield spark.read.parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
