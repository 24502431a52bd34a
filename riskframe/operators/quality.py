"""Data-quality checks (DQ1-DQ12) and the test suite (DQ9).

Per-column checks are fused into one aggregation per table; duplicate rows
need one grouped aggregation (partial aggregation first, so a row repeated a
third of the time is combined map-side); duplicate columns use a one-pass
fingerprint and then confirm only the candidate pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .gram import correlation_pairs
from .prefix import running_sums


def schema_conformance(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """DQ1: per declared column: present?, actual type, rows whose value does not cast."""
    spark = df.sparkSession
    actual = dict(df.dtypes)
    present = [c for c in declared if c in actual]
    aggs = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(declared[c]).isNull()).alias(c) for c in present]
    bad = df.agg(*aggs).unpivot([], present, "column", "bad_rows") if present else None
    meta = spark.createDataFrame([(c, t, actual.get(c), c not in actual) for c, t in declared.items()],
                                 "column string, expected string, actual string, missing boolean")
    if bad is None:
        return meta.withColumn("bad_rows", F.lit(None).cast("long"))
    return meta.join(bad, "column", "left")


def _profile_aggs(df: DataFrame, columns: Sequence[str]):
    aggs = [F.count(F.lit(1)).alias("_rows"),
            F.count_if(F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1
                       else F.col(columns[0]).isNull()).alias("_rows_with_null")]
    for i, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count_if(x.isNull()).alias(f"_n{i}"),
                 F.min(x).eqNullSafe(F.max(x)).alias(f"_k{i}"),
                 F.bit_xor(F.xxhash64(x)).alias(f"_h{i}")]
    return aggs


def table_checks(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    """DQ2-DQ6 on one table: one fused aggregation + one grouped count + candidate confirm.

    Returns plain counts (the result of aggregations, a handful of numbers).
    """
    columns = list(columns or df.columns)
    r = df.agg(*_profile_aggs(df, columns)).first()
    cols_with_missing = [c for i, c in enumerate(columns) if r[f"_n{i}"] > 0]
    constant = [c for i, c in enumerate(columns) if r[f"_k{i}"]]
    dup_rows = duplicated_rows(df, columns).first()["duplicated_rows"]
    dup_cols = duplicated_column_pairs(df, columns, fingerprints={c: r[f"_h{i}"] for i, c in enumerate(columns)})
    return {"rows": r["_rows"], "columns_with_missing": len(cols_with_missing),
            "rows_with_missing": r["_rows_with_null"], "constant_columns": len(constant),
            "duplicated_rows": dup_rows, "duplicated_columns": dup_cols.count(),
            "missing_by_column": {c: r[f"_n{i}"] for i, c in enumerate(columns)}}


def columns_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ2: number of columns holding at least one null."""
    columns = list(columns or df.columns)
    w = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return w.select(sum((F.col(c) > 0).cast("int") for c in columns).alias("columns_with_missing"))


def rows_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ3: number of rows with a null in any column."""
    columns = list(columns or df.columns)
    anynull = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    return df.agg(F.count_if(anynull).alias("rows_with_missing"))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ4: (column, is_constant): min <=> max in one pass; all-null counts as constant."""
    columns = list(columns or df.columns)
    w = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns])
    return w.unpivot([], columns, "column", "is_constant")


def duplicated_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ5: rows minus distinct rows (null-safe grouping, partial aggregation map-side)."""
    columns = list(columns or df.columns)
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicated_rows"))


def duplicated_column_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                            fingerprints: Mapping[str, int] | None = None) -> DataFrame:
    """DQ6: pairs of columns with equal type and equal values on every row.

    Pass 1 (or given ``fingerprints``): XOR of value hashes per column.  Only
    pairs with equal type and fingerprint are confirmed, in one more pass with
    a null-safe equality test per pair.
    """
    spark = df.sparkSession
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    if fingerprints is None:
        r = df.agg(*[F.bit_xor(F.xxhash64(F.col(c))).alias(f"_h{i}") for i, c in enumerate(columns)]).first()
        fingerprints = {c: r[f"_h{i}"] for i, c in enumerate(columns)}
    cands = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]
             if types[a] == types[b] and fingerprints[a] == fingerprints[b]]
    schema = "column_a string, column_b string"
    if not cands:
        return spark.createDataFrame([], schema)
    ok = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"_p{i}") for i, (a, b) in enumerate(cands)])
    pairs = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_p{i}").alias("_eq"))
                      for i, (a, b) in enumerate(cands)])
    return ok.select(F.explode(pairs).alias("p")).where("p._eq").select("p.column_a", "p.column_b")


def column_types_diff(reference: DataFrame, current: DataFrame) -> DataFrame:
    """DQ7: (column, reference_type, current_type, same) over the union of column names."""
    spark = current.sparkSession
    rt, ct = dict(reference.dtypes), dict(current.dtypes)
    names = list(dict.fromkeys([*reference.columns, *current.columns]))
    rows = [(c, rt.get(c), ct.get(c), rt.get(c) == ct.get(c)) for c in names]
    return spark.createDataFrame(rows, "column string, reference_type string, current_type string, same boolean")


def most_common(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, most_common): the most frequent non-null value as text, lowest text on ties.

    Counted per (column, value) with partial aggregation and reduced with ``min_by``, so the
    work is spread over values instead of one per-group value map."""
    st = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                       for c in columns])).alias("s")).select("s.*").where("value IS NOT NULL")
    counts = st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"))


def column_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                   exact: bool = False) -> DataFrame:
    """DQ10: per column count, missing, distinct, most common value; numeric: mean, std, min, quartiles, max.

    With ``exact=True`` the (column, value) counts are written once and every statistic follows
    from them, in one scan of the source.  Otherwise distinct counts and quartiles are sketches
    (``approx_count_distinct``, ``percentile_approx``: bounded memory).
    """
    from . import aggregates as A
    cols = [*numeric, *categorical]
    if exact:
        return _exact_profile(df, list(numeric), cols, A)
    out = []
    for c in cols:
        x = F.col(c)
        xd = x.cast("double") if c in numeric else F.lit(None).cast("double")
        out.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("count"), F.count_if(x.isNull()).alias("missing"),
            F.approx_count_distinct(x).alias("distinct"), F.avg(xd).alias("mean"), F.stddev_samp(xd).alias("std"),
            F.min(xd).alias("min"), F.max(xd).alias("max"), F.percentile_approx(xd, [0.25, 0.5, 0.75], 10000).alias("q")))
    wide = df.agg(*[s.alias(f"_c{i}") for i, s in enumerate(out)])
    stats = wide.select(F.explode(F.array(*[F.col(f"_c{i}") for i in range(len(out))])).alias("p")).select("p.*")
    prof = stats.join(most_common(df, cols), "column", "left")
    return prof.select("column", "count", "missing", "distinct", "most_common", "mean", "std", "min",
                       *[F.get("q", i).cast("double").alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def _exact_profile(df: DataFrame, numeric: list, cols: list, A) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"),
                      (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("value")) for c in cols]
    counts = A.keep(df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
                    .groupBy("column", "text", "value").agg(F.count(F.lit(1)).alias("n")), "profile-counts")
    some = F.col("text").isNotNull()
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(some).alias("distinct"),
        F.min_by("text", F.when(some, F.struct(-F.col("n"), F.col("text")))).alias("most_common"))
    numbers = counts.where("value is not null").select("column", "value", "n")
    moments = A._describe_counts(numbers, cols).drop("count")
    return stats.join(moments, "column", "left").select("column", "count", "missing", "distinct", "most_common", "mean",
                                                        "std", "min", "p25", "p50", "p75", "max")


def correlations(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """DQ10: Pearson correlation of every numeric pair, from one matrix (``gram``)."""
    return correlation_pairs(df, numeric)


def mid_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``'s rows in which all ``columns`` are known, with the mid-rank of each column's value in place of it
    (ties share the mean of their places).  A column's ranks come from the counts of its
    distinct values by two-phase running sums; NaN is the largest value."""
    out = df.select(*columns)
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    out = keep(out, "ranked-rows")
    for c in columns:
        counts = out.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        ranks = running_sums(counts, [], c, ["n"]).select(
            F.col(c).alias("_value"), (F.col("cum_n") - (F.col("n") - 1) / 2).cast("double").alias("_rank"))
        ranks = keep(ranks, "ranks")  # written, so that Spark may split the rows of a common value
        out = out.join(ranks, F.col(c).eqNullSafe(F.col("_value"))).withColumn(c, F.col("_rank")).drop("_value", "_rank")
    return out


def rank_correlations(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """DQ10: Spearman correlation of every numeric pair, over the rows in which all are known."""
    return correlation_pairs(mid_ranks(df, numeric), numeric, "spearman")


def associations(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """DQ10: Cramer's V of every pair of categorical columns, over the rows in which both are known:
    sqrt(chi2 / (n (min(values) - 1))), null where a column has one value.  All contingency
    tables are counted in one pass; their margins come from the written counts."""
    pairs = [(a, b) for i, a in enumerate(categorical) for b in categorical[i + 1:]]
    cells = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("a"),
                      F.col(b).cast("string").alias("b")) for a, b in pairs]
    key = ["column_a", "column_b"]
    counts = keep(df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("a is not null and b is not null")
                  .groupBy(*key, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")), "contingency")
    rows, cols = (keep(counts.groupBy(*key, c).agg(F.sum("n").alias(f"n_{c}")), f"margin-{c}") for c in "ab")
    sizes = rows.groupBy(*key).agg(F.sum("n_a").alias("total"), F.count(F.lit(1)).alias("values_a")).join(
        cols.groupBy(*key).agg(F.count(F.lit(1)).alias("values_b")), key)
    parts = counts.join(rows, [*key, "a"]).join(cols, [*key, "b"]).groupBy(*key).agg(
        F.sum(F.col("n") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("share"))
    least = F.least("values_a", "values_b") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.col("share") - 1, F.lit(0.0)) / least))
    listed = df.sparkSession.createDataFrame(pairs, "column_a string, column_b string")
    return listed.join(parts.join(sizes, key).select(*key, v.alias("cramers_v")), key, "left")


def conflicts(df: DataFrame, features: Sequence[str], outcome: str) -> DataFrame:
    """DQ11/DQ12: feature combinations seen with more than one outcome (target or prediction)."""
    g = df.groupBy(*features).agg(F.min(outcome).alias("min_value"), F.max(outcome).alias("max_value"),
                                  F.count(F.lit(1)).alias("rows"))
    return g.where(F.col("min_value") != F.col("max_value"))


def test_suite(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
               drifted: int | None = None, drift_limit: int | None = None,
               limits: Mapping[str, float] | None = None) -> DataFrame:
    """DQ9: one row per test (name, current, reference, limit, passed).

    Counting tests pass when the current value does not exceed the limit,
    which defaults to the reference table's own value.  The column-type test
    passes when every type equals the reference's; the drift test when the
    number of drifted columns is within ``drift_limit``.
    """
    spark = current.sparkSession
    columns = list(columns or current.columns)
    cur, ref = table_checks(current, columns), table_checks(reference, [c for c in columns if c in reference.columns])
    limits = dict(limits or {})
    rows = []
    for name in ("columns_with_missing", "rows_with_missing", "constant_columns", "duplicated_rows", "duplicated_columns"):
        lim = float(limits.get(name, ref[name]))
        rows.append((name, float(cur[name]), float(ref[name]), lim, cur[name] <= lim))
    same = sum(1 for c in columns if dict(reference.dtypes).get(c) != dict(current.dtypes).get(c))
    rows.append(("columns_type", float(same), 0.0, 0.0, same == 0))
    if drifted is not None:
        lim = float(drift_limit if drift_limit is not None else len(columns) // 3)
        rows.append(("drifted_columns", float(drifted), None, lim, drifted <= lim))
    return spark.createDataFrame(rows, "test string, current double, reference double, limit double, passed boolean")


def all_passed(suite: DataFrame) -> DataFrame:
    """DQ9: one row: number of tests, number failed, whether all passed."""
    return suite.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(~F.col("passed")).alias("n_failed")).select(
        "n_tests", "n_failed", (F.col("n_failed") == 0).alias("all_passed"))
