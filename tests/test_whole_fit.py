"""Searches, units and segment models are fitted on every row of the train part."""

import pytest
from pyspark.ml import Estimator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from riskframe.operators import training as ML
from riskframe.plans import q_training as Q

ROWS = 30_000  # 24,000 in the train part


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with lineitem rows."""
    folder = str(tmp_path_factory.mktemp("lines"))
    h = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    spark.range(ROWS).select(
        F.col("id").alias("l_orderkey"), (h(1, 7) + 1).cast("int").alias("l_linenumber"), (h(2, 90_000) + 1).cast("double").alias("l_extendedprice"),
        (h(3, 50) + 1).cast("double").alias("l_quantity"), (h(4, 11) / 100).alias("l_discount"), (h(5, 9) / 100).alias("l_tax"),
        F.expr("elt(id % 2 + 1, 'F', 'O')").alias("l_linestatus"), F.expr("elt(id % 4 + 1, 'R', 'A', 'N', 'N')").alias("l_returnflag")
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


class Seen(Exception):
    pass


@pytest.mark.parametrize("query", ["ml11_refit_evaluate", "ml14_train_job", "ml6_catboost_style_search", "ml9_family_search"])
def test_search_sees_the_whole_train_part(spark, lines, monkeypatch, query):
    def stop(est, params, train, *more):
        raise Seen(train.count(), train.select("k").distinct().count())

    monkeypatch.setattr(ML, "cross_validate", stop)
    with pytest.raises(Seen) as seen:
        getattr(Q, query)(spark, lines)
    assert seen.value.args == (0.8 * ROWS, 0.8 * ROWS)


@pytest.fixture
def counts(monkeypatch):
    """Rows that each classifier was fitted on."""
    found, make = [], ML.make_estimator

    class Spy(Estimator):
        def _fit(self, df):
            found.append(df.count())
            return make("GBT").setMaxIter(1).fit(df)

    monkeypatch.setattr(ML, "make_estimator", lambda *a, **b: Spy())
    return found


@pytest.mark.parametrize("query", ["snk6_model_unit", "sco2_probability_metrics"])
def test_classifier_of_a_unit_sees_the_whole_train_part(spark, lines, counts, query):
    out = getattr(Q, query)(spark, lines)
    assert counts == [0.8 * ROWS] and (out.count() if "k" in out.columns else out.agg(F.sum("n")).first()[0]) == ROWS


def test_classifier_of_a_segment_sees_all_its_train_rows(spark, lines, counts, monkeypatch):
    monkeypatch.setattr(Q, "fit_segments", lambda *a, **b: (SQLTransformer(statement="SELECT *, 0 AS cluster FROM __THIS__"), 1, []))
    assert Q.ml12_segment_models(spark, lines).count() == ROWS and counts == [0.8 * ROWS]


def test_files_of_the_rows_follow_their_number(spark):
    few, some = ML.written_rows(spark.range(1000), 1000), ML.written_rows(spark.range(1000), 1000, ("id",), 300)
    assert len(few.inputFiles()) == 1 and len(some.inputFiles()) == 3 and few.count() == some.count() == 1000
    assert len(ML.written_rows(spark.range(5000), 5000, least=1).inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
