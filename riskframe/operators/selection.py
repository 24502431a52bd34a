"""Model selection, promotion gates and keep-best registries (SEL1-SEL5, ML10).

All work on small metric/registry tables, reduced by partial aggregation;
nothing here touches row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_test_view(metrics: DataFrame, eval_param: str, split: str = "split",
                    model: str = "model", seq: str = "seq") -> DataFrame:
    """One row per model: train and test value of ``eval_param``, test accuracy, gap = train - test."""
    def pick(s, m):
        return F.max(F.when(F.col(split) == s, F.col(m)))
    v = metrics.groupBy(model, seq).agg(pick("train", eval_param).alias("train_score"),
                                        pick("test", eval_param).alias("test_score"),
                                        pick("test", "accuracy").alias("test_accuracy"))
    return v.withColumn("gap", F.col("train_score") - F.col("test_score"))


def flag_overfit(view: DataFrame, limit: float = 0.05) -> DataFrame:
    """SEL2: warning flag when the train-test gap exceeds ``limit``."""
    return view.withColumn("overfit_warning", F.col("gap") > F.lit(limit))


def best_model(metrics: DataFrame, eval_param: str, eval_difference: float, base_accuracy: float,
               split: str = "split") -> DataFrame:
    """SEL1: keep models with gap <= eval_difference and test accuracy >= base_accuracy;
    the smallest gap wins and a later model wins a tie.  Empty result = no acceptable model."""
    v = train_test_view(metrics, eval_param, split)
    ok = v.where((F.col("gap") <= F.lit(eval_difference)) & (F.col("test_accuracy") >= F.lit(base_accuracy)))
    return ok.orderBy(F.asc("gap"), F.desc("seq")).limit(1)


def challenger_gate(metrics: DataFrame, stored_threshold: float | None, eval_param: str, eval_difference: float,
                    base_accuracy: float, split: str = "split") -> DataFrame:
    """SEL4: evaluate production + candidates together, pick with SEL1 on ``eval_param``, then
    accept the pick only if its test accuracy beats the stored threshold (no threshold stored:
    accept); the threshold then becomes that accuracy.  No acceptable model: no row.
    """
    best = best_model(metrics, eval_param, eval_difference, base_accuracy, split)
    return gate(stored_threshold, best, "test_accuracy").select("model", "test_score", "test_accuracy", "accepted",
                                                                "new_threshold")


def gate_history(candidates: DataFrame, key: str, seq: str, score: str, initial: float | None = None) -> DataFrame:
    """SEL3 as a history: a candidate is accepted iff its score beats every earlier score
    of the key (and the stored ``initial`` threshold); the threshold then becomes its score.

    The maximum over earlier candidates uses the two-phase running maximum, so one key with
    a third of all candidates is still split over many tasks.  Candidates are ordered by ``seq``
    as it is (numbers, dates or text); a NaN score is never accepted.
    """
    from .prefix import running_max_before
    r = running_max_before(candidates, [key], seq, score, name="_prev_max")
    prev = F.col("_prev_max")
    beats = F.coalesce(~F.isnan(F.col(score).cast("double")), F.lit(False))
    if initial is not None:
        prev = F.greatest(F.coalesce(prev, F.lit(initial)), F.lit(initial))
    acc = beats & F.when(prev.isNull(), F.lit(True)).otherwise(F.col(score) > prev)
    return r.withColumns({"threshold_before": prev, "accepted": acc}).drop("_prev_max")


def gate(stored_threshold: float | None, test_score: DataFrame, score: str = "test_score") -> DataFrame:
    """SEL3 single decision: accept iff the new test score is strictly above the stored one;
    the threshold then becomes the accepted score."""
    thr = F.lit(stored_threshold).cast("double")
    acc = ~F.isnan(F.col(score)) & (thr.isNull() | (F.col(score) > thr))
    return test_score.withColumns({"accepted": acc,
                                   "new_threshold": F.when(acc, F.col(score)).otherwise(thr)})


def _pick_per_key(allrows: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row per key: the row with the greatest ``rank`` struct.  ``max_by`` aggregates
    partially before the shuffle, so a key holding a third of all rows is reduced map-side
    instead of being sorted in one task by a window."""
    others = [c for c in allrows.columns if c != key]
    best = allrows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in others]).select(*allrows.columns)


def keep_best(registry: DataFrame, new: DataFrame, key: str, score: str, seq: str = "seq") -> DataFrame:
    """ML10: upsert keeping, per key, the strictly best score (earlier entry wins a tie).  A NaN
    or null score never beats a number."""
    number = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    rank = F.struct(number.isNotNull(), number, -F.col(seq))
    return _pick_per_key(registry.unionByName(new), key, rank)


def upsert_first_wins(history: DataFrame, new: DataFrame, key: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """SEL5: append run records; on an equal key the older entry (lowest ``order``) is kept."""
    return _pick_per_key(history.unionByName(new), key, F.struct(*[-F.col(c) for c in order]))
