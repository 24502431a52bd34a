"""Helpers shared by the operators of this subpackage.

Rules that hold for every operator here:

* An operator selects the columns it is told to use, renames them to its own
  names at once and returns its own result columns, so further input columns
  (also ones whose names clash with result columns) neither break nor change it.
* Result rows match input rows one to one unless the docstring says otherwise;
  a repeated row gives a repeated result row, a null id stays null.
* Tables that are read more than once are written to the folder named in
  ``spark.checkpoint.dir`` and read back, which also cuts the lineage: a lost
  executor costs one task, never the whole history.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import maybe_known
from ..session import scratch_path, table  # noqa: F401  (re-exported)


class Scratch:
    """Tables in the shared folder; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def keep(self, df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and read it back."""
        path = scratch_path(self.spark, f"{self.name}-{what}")
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def release(self) -> None:
        """Free the disk of finished steps: Spark's cleaner removes their shuffle files
        once the driver has collected the frames as garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text of an Arrow string column; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of a column (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(text).nbytes
        if size <= most:
            yield batch
            continue
        step = max(1, batch.num_rows * most // size)
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, step)
            n = part.num_rows
            while n > 1 and part.column(text).nbytes > 2 * most:
                n = max(1, n // 2)
                part = batch.slice(at, n)
            yield part
            at += n


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow file system and path of a folder (file:, hdfs:, s3:, gs: or a plain path)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


def share(spark: SparkSession, value):
    """Broadcast a small fitted object; call the result in a task to get it.  (Pickled
    with its class, which the executors need not have installed.)"""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def bounded_draw(rows: DataFrame, most: int, n: int, seed: int = 7) -> DataFrame:
    """At most ``most`` of ``n`` rows, about as many: a random share of them before a limit, so that
    the task of the limit sees few more than that."""
    drawn = rows.withColumn("draw", F.rand(seed))
    if n > most:
        drawn = drawn.where(F.col("draw") < 1.2 * most / n)
    return lowest(drawn, most)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str,
                    most: int) -> DataFrame:
    """(id as string, label, text, draw): about 1.2 times ``most`` rows of the join of documents and their
    labels 0 or 1, however often an id stands on either side; only drawn texts are shuffled.
    ``lowest`` makes it ``most`` rows, once texts are turned into something smaller."""
    marked = (labels.select(F.col(label_id).cast("string").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)"))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    one = F.count(F.lit(1))
    n = (texts.groupBy("id").agg(one.alias("d")).join(marked.groupBy("id").agg(one.alias("l")), "id")
         .agg(F.sum(F.col("d") * F.col("l"))).first()[0] or 0)
    if n > most:
        texts = texts.where(F.rand(5) < 1.2 * most / n)
        # texts that a bounded filter of the labelled ids rules out are not shuffled
        ids = marked.select("id").distinct()
        texts = maybe_known(texts, ids, "id", ids.count()).where("_maybe").drop("_maybe")
    return texts.join(marked, "id").select("id", "label", "text", F.rand(6).alias("draw"))


def lowest(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of the lowest ``draw``."""
    return rows.orderBy("draw").limit(most).drop("draw")
