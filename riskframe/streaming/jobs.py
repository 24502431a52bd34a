"""Structured Streaming re-aims of the online paths (STR1, STR2).

STR1: validate incoming rows, score the valid ones, send the rest to a
quarantine table - two sinks written per micro-batch with ``foreachBatch``;
each batch writes its own ``batch=<id>`` folder in overwrite mode, so a
replayed batch after a failure replaces its earlier output (idempotent).

STR2: insert-if-new by key on a stream, either with a look-back bounded by a watermark, kept
by Spark's own state on RocksDB (late rows with unseen keys are set aside, not lost), or
against the growing target table itself, bucketed by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import rule_violations
from ..operators.merge import rows_to_insert
from ..sources.files import path_exists


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (directory or glob) as a stream; ``max_files``
    bounds the files of a micro-batch (none: all that have arrived)."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def validate_and_score(stream: DataFrame, rules: Mapping[str, Column], scorer: Callable[[DataFrame], DataFrame],
                       out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """STR1: rows breaking any rule go to ``out_dir/quarantine`` (with reasons); valid rows are
    scored by ``scorer`` and written to ``out_dir/scored``."""
    checked = stream.withColumn("violations", rule_violations(rules))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = batch.where(F.size("violations") == 0).drop("violations")
            scorer(good).write.mode("overwrite").parquet(f"{out_dir}/scored/batch={batch_id}")
            bad = batch.where(F.size("violations") > 0).withColumn("violations", F.array_join("violations", ","))
            bad.write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch={batch_id}")
        finally:
            batch.unpersist()

    w = checked.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB (outside the heap, spilled to disk), with
    changelog checkpoints, so that a commit writes what has changed."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _earlier(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows that micro-batches before this one have written below ``path``."""
    return spark.read.parquet(path).where(F.col("batch") < batch_id) if path_exists(spark, path) else None


def insert_new_within_watermark(stream: DataFrame, reference: DataFrame, key: str, event_time: str,
                                delay: str, out_dir: str, checkpoint: str,
                                available_now: bool = True) -> StreamingQuery:
    """STR2 (bounded look-back): the first row of each key goes to ``out_dir/accepted``.

    A key is known if it is in the static ``reference`` or in the state of
    ``dropDuplicatesWithinWatermark``, which forgets it once the watermark (latest event of earlier
    micro-batches minus ``delay``) has passed its event time by ``delay``: the state holds the keys of
    that span only, and no micro-batch reads what was accepted before.

    Spark's state drops rows that are not after the watermark.  Those with a key never seen are kept
    in ``out_dir/late``, each key once: only they, and only where there are any, are
    compared with all accepted and late rows.  Each micro-batch writes its own ``batch=<id>`` folders
    in overwrite mode, so a replayed batch replaces its earlier output.
    """
    spark = stream.sparkSession
    if dict(stream.dtypes)[event_time] == "timestamp_ntz":  # a watermark needs an instant
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    first = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    known = reference.select(key).distinct()
    # the same micro-batch twice: what the state lets pass, and all rows, to find the late ones
    both = (rows_to_insert(first, known, key).withColumn("_first", F.lit(True))
            .unionByName(stream.withColumn("_first", F.lit(False))))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            accepted, rows = batch.where("_first").drop("_first"), batch.where("NOT _first").drop("_first")
            accepted.write.mode("overwrite").parquet(f"{out_dir}/accepted/batch={batch_id}")
            top = None
            progress = _earlier(spark, f"{out_dir}/progress", batch_id)
            if progress is not None:
                top = progress.agg(F.max("latest")).first()[0]
            mark = F.date_trunc("MILLISECOND", F.lit(top).cast("timestamp")) - F.expr(f"INTERVAL {delay}")
            late = rows.where(F.col(event_time) <= mark).dropDuplicates([key]) if top is not None else rows.limit(0)
            if top is not None and not late.isEmpty():
                late = rows_to_insert(late, known, key)
                for name in ("accepted", "late"):
                    earlier = _earlier(spark, f"{out_dir}/{name}", batch_id + (name == "accepted"))
                    if earlier is not None:
                        late = rows_to_insert(late, earlier, key)
            late.write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")
            rows.agg(F.max(event_time).alias("latest")).write.mode("overwrite").parquet(f"{out_dir}/progress/batch={batch_id}")
        finally:
            batch.unpersist()

    w = both.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    with rocksdb_state(spark):
        return w.start()


def insert_new_into_table(stream: DataFrame, table_path: str, key: str, checkpoint: str,
                          available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """STR2 (unbounded history): each micro-batch is de-duplicated by key and anti-joined with
    the target table as it stands, then appended to it.  The target is partitioned by a hash
    bucket of the key, so a micro-batch reads the keys of its own buckets only; a replayed
    batch finds its rows already present."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = (batch.dropDuplicates([key]).withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
               .persist())
        try:
            fresh = new
            if path_exists(spark, table_path):
                own = [r[0] for r in new.select("key_bucket").distinct().collect()]  # at most ``buckets`` numbers
                current = spark.read.parquet(table_path).where(F.col("key_bucket").isin(own)).select(key)
                fresh = rows_to_insert(new, current, key)
            fresh.write.mode("append").partitionBy("key_bucket").parquet(table_path)
        finally:
            new.unpersist()

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
