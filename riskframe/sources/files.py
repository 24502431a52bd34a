"""Sources and sinks (SRC1-SRC3, SNK1-SNK3, SNK6).

Reads always carry an explicit schema (no inference pass over the data);
tables are Parquet so filters and projections reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .versions import VersionedStore


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
             corrupt_col: str | None = None) -> DataFrame:
    """SRC1: CSV scan with header and a declared schema (PERMISSIVE mode).

    With ``corrupt_col`` (named in the schema or not) lines that do not fit the schema are kept
    in that column as text instead of failing the job.  Fields are read as text and cast here,
    so whether a line is corrupt never depends on the columns a query selects.
    """
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if not corrupt_col:
        return r.schema(schema).csv(path)
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = [f for f in declared.fields if f.name != corrupt_col]
    text = StructType([*[StructField(f.name, StringType()) for f in fields], StructField(corrupt_col, StringType())])
    lines = r.schema(text).option("columnNameOfCorruptRecord", corrupt_col).csv(path)
    cells = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = reduce(lambda a, b: a | b, [F.col(n).isNotNull() & c.isNull() for n, c in cells.items()])
    line = F.coalesce(F.col(corrupt_col), F.when(bad, F.to_csv(F.struct(*cells))))
    return lines.select(*[c.alias(n) for n, c in cells.items()], line.alias(corrupt_col))


#: part of a single versioned table
TABLE = "table"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: validated-table scan: the newest whole version of a table that ``replace_table``
    keeps, pinned when it is read; any other path is plain Parquet."""
    snapshot = VersionedStore(spark, path).snapshot()
    return snapshot.read(spark, TABLE) if snapshot else spark.read.parquet(path)


def read_reference(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC3: the stored reference table, or an empty frame with ``schema`` on the first run."""
    snapshot = VersionedStore(spark, path).snapshot()
    if snapshot:
        return snapshot.read(spark, TABLE, schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1: CSV with header, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """SNK2: overwrite a table that ``df`` may itself read from.

    The new version is written next to the old one and made the current one by a single
    rename (``versions``): a table is never absent, readers keep the version they have pinned, and a
    job that dies before the rename changes nothing.  The version before last is removed, so that a
    reader of the last one is not disturbed.
    """
    store = VersionedStore(df.sparkSession, path)
    store.commit({TABLE: df}, base=store.snapshot())
    store.vacuum(keep=2)


def append_table(df: DataFrame, path: str) -> None:
    """SNK3: record append (new Parquet files next to the existing ones)."""
    df.write.mode("append").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


#: most records of a metric report; more would not fit one JSON object in one task
REPORT_RECORDS = 100_000


def write_json_report(records, path: str, key: str = "key", value: str = "value") -> None:
    """SNK4: (key, value) metric records written as one JSON object ``{key: value, ...}``.

    The records are a metric report (tens of rows, already aggregated), so a single output
    file is written."""
    n = records.limit(REPORT_RECORDS + 1).count()
    if n > REPORT_RECORDS:
        raise ValueError(f"a report holds at most {REPORT_RECORDS} records")
    obj = records.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value)))).alias("report"))
    obj.coalesce(1).write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str):
    """Read a report written by ``write_json_report`` back as (key, value) rows."""
    r = spark.read.schema("report map<string,double>").json(path)
    return r.select(F.explode("report").alias("key", "value"))
