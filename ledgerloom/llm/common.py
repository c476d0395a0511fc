"""What the corpus operators share: reading, written intermediate tables, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def workspace(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset below a temporary
    one, which a cluster's executors would not share: then this raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, path[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    folder = f"{path.rstrip('/')}/{spark.sparkContext.applicationId}"  # removed when the driver ends
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return folder


def materialize(df: DataFrame, name: str, codec: str | None = "zstd") -> DataFrame:
    """Write df below the shared checkpoint folder and read it back: lineage is cut, and a
    lost executor costs no recomputation. Unlike checkpoint(), it computes df only once.
    codec None: as the session writes its own tables."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and that no later plan reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ledgerloom_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column has (in any case of letters)."""
    taken, k, out = {c.lower() for c in columns}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def slices(batches, rows: int = 256, size: int = 1 << 20):
    """Arrow batches in parts of at most `rows` rows and about `size` bytes of text (a longer
    text is a part of its own), for work that needs many times a text's memory."""
    for batch in batches:
        text = batch.schema.get_field_index("text")
        if text < 0:
            total = np.zeros(batch.num_rows, np.int64)
        else:
            total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(total, done + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def running_totals(df: DataFrame, order: str, n: str) -> DataFrame:
    """df (without nulls in order, a long without repeats) with before: the sum of the long n
    over the rows of smaller order. Rows are partitioned by ranges of order; what comes together
    in one task is a sum for each partition."""
    names = df.columns

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(n).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sums), part)), pa.array(total + sums - batch.column(n).to_numpy())], [*names, "__part", "__own"])
            total += int(sums[-1]) if len(sums) else 0

    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    held = materialize(ranged.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, __part long, __own long"), "running")
    parts = held.groupBy("__part").agg(F.sum(n).alias("sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("__base"))  # a row per partition
    return held.join(F.broadcast(parts), F.col("__part") == F.col("__p")).select(*names, (F.col("__base") + F.col("__own")).alias("before"))


def local_components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (a[i], b[i])."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        la, lb = la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the graph stays in
    distributed tables, each round is written to the shared folder, and rounds grow with the
    logarithm of the number of nodes. Self links and repeated links are ignored; a node
    without links has no row; null ends are ignored.
    """
    def signature(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(star, name)
        discard(now)
        now, mark = after, signature(after)
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
