"""One-hot encoding as a saveable ML stage (FE4 inside FE10).

``CategoryEncoder`` is an ``Estimator``: it finds the distinct values of its columns and keeps
them as a table, one row per (column, value), numbers in numeric order and as they are
(fractions, large and negative numbers stay apart; -0.0 is 0.0).  ``CategoryEncoderModel`` joins that table
column by column and lets Spark's ``OneHotEncoder`` make sparse vectors.  Saving writes the
table as Parquet beside the stage's metadata; loading reads it there.  The driver holds
the number of values per column, never the values, so there may be any number of them.

Null and unseen values have no bit set; a column without values has an empty part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import OneHotModel

#: added to the names of the columns that hold the values to encode
TEXT = "__category"


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the values to encode in ``<column>__category``: fractional types without -0.0."""
    plain = {c: F.when(F.col(c) == 0, F.lit(0).cast(t)).otherwise(F.col(c)) if t in ("double", "float") else F.col(c)
             for c, t in df.dtypes if c in columns}
    return df.withColumns({c + TEXT: plain[c] for c in columns})


class CategoryEncoder(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot of ``inputCols``, one after the other, as one sparse vector in ``outputCol``."""

    def __init__(self, inputCols: Sequence[str] = (), outputCol: str = "encoded"):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCol=outputCol)

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        columns = self.getInputCols()
        texts = _values(df, columns).select(*[F.col(c + TEXT).alias(c) for c in columns])
        return CategoryEncoderModel(columns, self.getOutputCol(), OneHotModel.fit(texts, columns))


class CategoryEncoderModel(Model, HasInputCols, HasOutputCol, MLReadable, MLWritable):
    def __init__(self, inputCols: Sequence[str] = (), outputCol: str = "encoded", onehot: OneHotModel | None = None):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCol=outputCol)
        self.onehot = onehot

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.getInputCols()
        inner = OneHotModel([c + TEXT for c in columns], self.onehot.dictionary.withColumn("column", F.concat("column", F.lit(TEXT))),
                            {c + TEXT: n for c, n in self.onehot.sizes.items()})
        return inner.transform(_values(df, columns), self.getOutputCol()).drop(*[c + TEXT for c in columns])

    def dictionary(self) -> DataFrame:
        """(column, value, local_index, feature_index)."""
        return self.onehot.dictionary.select("column", "value", "local_index", "feature_index")

    def names(self, shown: Mapping[str, str] | None = None) -> list[str]:
        """``COL_value`` in feature order (on the driver: one per feature), whole numbers without a fraction;
        ``shown``: other names of the columns."""
        shown = dict(shown or {})
        column = F.create_map(*[F.lit(x) for c in self.getInputCols() for x in (c, shown.get(c, c))])[F.col("column")]
        number = F.col("value_num")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        value = F.when(whole, F.col("value_num").cast("bigint").cast("string")).otherwise(F.col("value"))
        rows = self.onehot.dictionary.orderBy("feature_index").select(F.concat_ws("_", column, value))
        return [r[0] for r in rows.collect()]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CategoryEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"sizes": self.model.onehot.sizes})
        self.model.onehot.dictionary.write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> CategoryEncoderModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = CategoryEncoderModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.onehot = OneHotModel(model.getInputCols(), spark.read.parquet(f"{path}/dictionary"), metadata["sizes"])
        return model
