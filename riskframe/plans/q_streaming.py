"""Demo queries: streaming validate + score (STR1) and streaming insert-if-new (STR2).

The stream source is the events table: its Parquet file is read as a file
stream; for the de-duplication demos Spark writes the events into a landing
folder in two arrivals with repeated and late rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..streaming import jobs as ST
from .registry import register


def event_rules():
    return {"value_positive": F.col("value") > 0, "value_below_50": F.col("value") < 50,
            "known_type": F.col("event_type").isin("view", "click", "purchase", "signup")}


def linear_scorer(df):
    """Fixed logistic scorer on the event value (P(1) = sigmoid((value - 10) / 5))."""
    return df.select("event_id", "user_id", "event_type",
                     F.round(1 / (1 + F.exp(-(F.col("value") - 10) / 5)), 6).alias("prediction"))


_RULES_SQL = """list_filter([CASE WHEN NOT coalesce(value > 0, false) THEN 'value_positive' END,
  CASE WHEN NOT coalesce(value < 50, false) THEN 'value_below_50' END,
  CASE WHEN NOT coalesce(event_type IN ('view', 'click', 'purchase', 'signup'), false) THEN 'known_type' END],
  lambda x: x IS NOT NULL)"""


@register("str1_stream_validate_score", f"""
WITH v AS (SELECT *, {_RULES_SQL} AS viol FROM events)
SELECT event_id, user_id, event_type, round(1 / (1 + exp(-(value - 10) / 5)), 6) AS prediction,
  NULL::VARCHAR AS violations FROM v WHERE len(viol) = 0
UNION ALL SELECT event_id, user_id, event_type, NULL::DOUBLE, array_to_string(viol, ',') FROM v WHERE len(viol) > 0""")
def str1_stream_validate_score(spark, sf):
    """Events stream -> rule check -> valid rows scored, invalid rows quarantined (two sinks)."""
    src = f"{sf}/events*.parquet"
    schema = table(spark, sf, "events").schema
    out, ckpt = scratch_path(spark, "str1-out"), scratch_path(spark, "str1-ckpt")
    q = ST.validate_and_score(ST.file_stream(spark, src, schema), event_rules(), linear_scorer, out, ckpt)
    q.awaitTermination()
    scored = spark.read.parquet(f"{out}/scored").select("event_id", "user_id", "event_type", "prediction",
                                                        F.lit(None).cast("string").alias("violations"))
    bad = spark.read.parquet(f"{out}/quarantine").select("event_id", "user_id", "event_type",
                                                         F.lit(None).cast("double").alias("prediction"), "violations")
    return scored.unionByName(bad)


_HELD = "event_id % 50 = 0"


def _arrivals(spark, sf):
    """Events in two arrivals: all but the held-back ones (every fiftieth), then all of them."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.schema, [ev.where(f"NOT ({_HELD})"), ev]


@register("str2_stream_insert_watermark", f"""
WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events WHERE NOT ({_HELD}))
SELECT event_id, user_id, event_type, value, (({_HELD}) AND ts < mark) AS late FROM events, m
WHERE ts >= TIMESTAMP '2024-01-10'""")
def str2_stream_insert_watermark(spark, sf):
    """Two arrivals of events, each one or more micro-batches: repeated keys and keys of the reference
    (events before 2024-01-10) are dropped; held-back events that come more than a day late are set
    aside, the others accepted."""
    schema, arrivals = _arrivals(spark, sf)
    ref = table(spark, sf, "events").where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    path, out, ckpt = (scratch_path(spark, n) for n in ("events-landing", "str2-out", "str2-ckpt"))
    for part in arrivals:
        part.write.mode("append").parquet(path)
        q = ST.insert_new_within_watermark(ST.file_stream(spark, path, schema), ref, "event_id", "ts", "1 day", out, ckpt)
        q.awaitTermination()
    cols = ["event_id", "user_id", "event_type", "value"]
    return spark.read.parquet(f"{out}/accepted").select(*cols, F.lit(False).alias("late")).unionByName(
        spark.read.parquet(f"{out}/late").select(*cols, F.lit(True).alias("late")))


_HOURS = "CASE WHEN event_id % 97 = 0 THEN 2 WHEN event_id % 53 = 0 THEN 1 ELSE 0 END"


@register("str2_stream_insert_state", f"""
WITH e AS (SELECT *, {_HOURS} AS held FROM events),
m AS (SELECT max(ts) FILTER (WHERE held = 0) - INTERVAL 2 HOUR AS m1, max(ts) FILTER (WHERE held < 2) - INTERVAL 2 HOUR AS m2 FROM e)
SELECT event_id, user_id, value, (held = 1 AND ts <= m1) OR (held = 2 AND ts <= m2) AS late, 1::BIGINT AS times FROM e, m""")
def str2_stream_insert_state(spark, sf):
    """Four arrivals, the query stopped and restarted from its checkpoint between them: most events, then
    those held back once with all earlier ones again, then those held back twice, then everything
    once more.  Every event is accepted or set aside as late, exactly once."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value", F.expr(_HOURS).alias("held"))
    path, out, ckpt = (scratch_path(spark, n) for n in ("events-landing", "str2s-out", "str2s-ckpt"))
    nothing = ev.limit(0).drop("held")
    for part in (ev.where("held = 0"), ev.where("held < 2"), ev, ev):
        part.drop("held").write.mode("append").parquet(path)
        q = ST.insert_new_within_watermark(ST.file_stream(spark, path, nothing.schema), nothing, "event_id", "ts", "2 hours", out, ckpt)
        q.awaitTermination()
    rows = [spark.read.parquet(f"{out}/{name}").withColumn("late", F.lit(name == "late")) for name in ("accepted", "late")]
    return rows[0].unionByName(rows[1]).groupBy("event_id").agg(
        F.min("user_id").alias("user_id"), F.min("value").alias("value"), F.max("late").alias("late"), F.count(F.lit(1)).alias("times"))


@register("str2_stream_insert_table", """
SELECT event_id, user_id, event_type, value FROM events""")
def str2_stream_insert_table(spark, sf):
    """The same arrivals inserted into a table only when the key is new: the second arrival adds
    the held-back events alone."""
    schema, arrivals = _arrivals(spark, sf)
    path, target, ckpt = (scratch_path(spark, n) for n in ("events-landing", "str2-table", "str2t-ckpt"))
    for part in arrivals:
        part.write.mode("append").parquet(path)
        q = ST.insert_new_into_table(ST.file_stream(spark, path, schema), target, "event_id", ckpt)
        q.awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", "value")


@register("str1_stream_model_scoring")
def str1_stream_model_scoring(spark, sf):
    """Lineitem rows arriving as a file stream are checked against the request rules; valid
    rows are scored by a fitted feature-unit + GBT PipelineModel (trained on the batch table's
    train split), invalid rows are quarantined with their reasons."""
    from ..operators import scoring as SCO
    from ..operators import training as ML
    from .q_training import request_rules, split_labelled, unit
    d = split_labelled(spark, sf)
    stages = [*unit().getStages(), ML.make_estimator("GBT")]
    train = d.where(F.col("split") == "train")
    model = ML.fit_unit(stages, train)
    schema = table(spark, sf, "lineitem").schema
    raw = ST.file_stream(spark, f"{sf}/lineitem*.parquet", schema)
    # the same derived request columns as the batch table (native expressions on the stream)
    stream = raw.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"),
                        "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus")
    out, ckpt = scratch_path(spark, "str1m-out"), scratch_path(spark, "str1m-ckpt")
    q = ST.validate_and_score(stream, request_rules(), lambda b: SCO.score(model, b, ["k"]), out, ckpt)
    q.awaitTermination()
    scored = spark.read.parquet(f"{out}/scored").select("k", "predicted", "prediction",
                                                        F.lit(None).cast("string").alias("violations"))
    bad = spark.read.parquet(f"{out}/quarantine").select(
        "k", F.lit(None).cast("int").alias("predicted"), F.lit(None).cast("double").alias("prediction"), "violations")
    return scored.unionByName(bad)
