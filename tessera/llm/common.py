"""What the operators of this folder share: word rule, scratch tables, components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``table`` writes a frame and reads it back; ``drop`` deletes those that no later
    result reads, ``only`` all but some. What a returned lazy frame still reads stays until the
    folder is cleaned by its owner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[str] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.held.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark delete the shuffle files of frames that are no longer referenced: it does when the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        self.held = [n for n in self.held if n not in names]

    def only(self, *names: str) -> None:
        self.drop(*[n for n in self.held if n not in names])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(id, component)``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the
    edge set no longer changes. Each round is two aggregations, its edges are a
    written table, and no group is collected: neighbours only meet through
    ``min``. ``component`` is the smallest id of the component; ids without
    edges do not appear.
    """
    cur = scratch.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0"
    )
    mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    k = 0
    while mark["n"]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large-star: every larger neighbour of u moves to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        k += 1
        nxt = scratch.table(small, f"{name}{k}")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}{k - 1}")
        cur = nxt
        if now == mark:
            break
        mark = now
    stars = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
