"""Connected components by star contraction, on tables only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def own_folder(spark: SparkSession, root: str) -> str:
    """The folder of this application below root; it is removed when the driver ends."""
    folder = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir (on a local master, a temporary
    one where that is unset) and read back, which cuts its lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, root[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{own_folder(spark, root)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that written() wrote and that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ledgerloom_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014), each written out; a round count
    logarithmic in the nodes, no recursion and no collected graph.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(now)
        now = after
