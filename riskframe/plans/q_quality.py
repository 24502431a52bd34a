"""Demo queries: data-quality checks and the validate-then-merge job (DQ1-DQ13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import stable_round
from ..operators import quality as Q
from ..operators.split import stratified_split
from ..session import keep, scratch_path, table
from ..sources.versions import VersionedStore
from ..operators.drift import dataset_drift, drift_table
from .q_drift import _DR5_SQL, CAT, NUM, _sides
from .q_metrics import P as PRED_SQL
from .q_metrics import predictions
from .registry import register
from .validation import validate_and_merge

_DUCK_TYPE = """CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' ELSE lower({t}) END"""

DECLARED = {"c_custkey": "int", "c_acctbal": "int", "c_mktsegment": "int", "c_name": "string", "c_phone": "string"}


@register("dq1_schema_conformance", f"""
WITH d("column", expected) AS (VALUES ('c_custkey', 'int'), ('c_acctbal', 'int'), ('c_mktsegment', 'int'),
  ('c_name', 'string'), ('c_phone', 'string')),
t AS (SELECT column_name AS "column", {_DUCK_TYPE.format(t="column_type")} AS actual FROM (DESCRIBE customer)),
b AS (SELECT * FROM (UNPIVOT (SELECT count_if(c_custkey IS NOT NULL AND TRY_CAST(c_custkey AS INTEGER) IS NULL) AS c_custkey,
  count_if(c_acctbal IS NOT NULL AND TRY_CAST(c_acctbal AS INTEGER) IS NULL) AS c_acctbal,
  count_if(c_mktsegment IS NOT NULL AND TRY_CAST(c_mktsegment AS INTEGER) IS NULL) AS c_mktsegment,
  count_if(c_name IS NOT NULL AND TRY_CAST(c_name AS VARCHAR) IS NULL) AS c_name FROM customer)
  ON COLUMNS(*) INTO NAME "column" VALUE bad_rows))
SELECT d."column", d.expected, t.actual, t.actual IS NULL AS missing, b.bad_rows::BIGINT AS bad_rows
FROM d LEFT JOIN t USING ("column") LEFT JOIN b USING ("column")""")
def dq1_schema_conformance(spark, sf):
    return Q.schema_conformance(table(spark, sf, "customer"), DECLARED)


def quality_frame(spark, sf):
    """lineitem projection with planted nulls, a constant column and a duplicated column."""
    li = table(spark, sf, "lineitem")
    return li.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount",
                     F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
                     F.col("l_discount").alias("l_discount_copy"), F.lit("x").alias("const_col"),
                     F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("l_linenumber_open"))


QF = """(SELECT l_returnflag, l_linestatus, l_quantity, l_discount, nullif(l_tax, 0.0) AS l_tax,
  l_discount AS l_discount_copy, 'x' AS const_col, CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS l_linenumber_open
  FROM lineitem)"""
QF_COLS = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_discount_copy", "const_col",
           "l_linenumber_open")


def _anynull(cols):
    return " OR ".join(f"{c} IS NULL" for c in cols)


@register("dq2_columns_with_missing", f"""
SELECT ({" + ".join(f"(count_if({c} IS NULL) > 0)::INT" for c in QF_COLS)}) AS columns_with_missing FROM {QF}""")
def dq2_columns_with_missing(spark, sf):
    return Q.columns_with_missing(quality_frame(spark, sf))


@register("dq3_rows_with_missing", f"SELECT count_if({_anynull(QF_COLS)}) AS rows_with_missing FROM {QF}")
def dq3_rows_with_missing(spark, sf):
    return Q.rows_with_missing(quality_frame(spark, sf))


@register("dq4_constant_columns", f"""
SELECT * FROM (UNPIVOT (SELECT {", ".join(f"min({c}) IS NOT DISTINCT FROM max({c}) AS {c}" for c in QF_COLS)} FROM {QF})
  ON COLUMNS(*) INTO NAME "column" VALUE is_constant)""")
def dq4_constant_columns(spark, sf):
    return Q.constant_columns(quality_frame(spark, sf))


@register("dq5_duplicated_rows", f"""
SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicated_rows FROM (SELECT count(*) AS c FROM {QF} GROUP BY {", ".join(QF_COLS)})""")
def dq5_duplicated_rows(spark, sf):
    return Q.duplicated_rows(quality_frame(spark, sf))


def _pairs_sql(cols, types_equal):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:] if types_equal(a, b)]
    checks = ", ".join(f"bool_and({a} IS NOT DISTINCT FROM {b}) AS p{i}" for i, (a, b) in enumerate(pairs))
    union = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, p{i} AS eq FROM c"
                               for i, (a, b) in enumerate(pairs))
    return f"WITH c AS (SELECT {checks} FROM {QF}) SELECT column_a, column_b FROM ({union}) WHERE eq"


_QF_TYPES = {"l_returnflag": "s", "l_linestatus": "s", "const_col": "s", "l_quantity": "d", "l_discount": "d",
             "l_tax": "d", "l_discount_copy": "d", "l_linenumber_open": "i"}


@register("dq6_duplicated_columns", _pairs_sql(QF_COLS, lambda a, b: _QF_TYPES[a] == _QF_TYPES[b]))
def dq6_duplicated_columns(spark, sf):
    return Q.duplicated_column_pairs(quality_frame(spark, sf))


@register("dq7_column_types", f"""
WITH r AS (SELECT column_name AS "column", {_DUCK_TYPE.format(t="column_type")} AS reference_type FROM (DESCRIBE customer)),
c AS (SELECT column_name AS "column", {_DUCK_TYPE.format(t="column_type")} AS current_type FROM
  (DESCRIBE SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment,
   c_nationkey * 2 AS c_extra FROM customer))
SELECT "column", reference_type, current_type, reference_type IS NOT DISTINCT FROM current_type AS same
FROM r FULL OUTER JOIN c USING ("column")""")
def dq7_column_types(spark, sf):
    ref = table(spark, sf, "customer")
    cur = ref.withColumn("c_acctbal", F.col("c_acctbal").cast("string")).withColumn("c_extra", F.col("c_nationkey") * 2)
    return Q.column_types_diff(ref, cur)


_PROFILE_NUM = ("l_quantity", "l_discount", "l_tax")
_PROFILE_CAT = ("l_returnflag", "l_linestatus")


def _profile_sql():
    parts = []
    for c in _PROFILE_NUM + _PROFILE_CAT:
        num = c in _PROFILE_NUM
        xd = f"{c}::DOUBLE" if num else "NULL::DOUBLE"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS count, count_if({c} IS NULL) AS missing,
  count(DISTINCT {c}) AS distinct,
  (SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)
   ORDER BY n DESC, v LIMIT 1) AS most_common,
  round(avg({xd})::DECIMAL(38, 12), 6)::DOUBLE AS mean, round(stddev_samp({xd})::DECIMAL(38, 12), 6)::DOUBLE AS std, min({xd}) AS min,
  round(quantile_cont({xd}, 0.25), 6) AS p25, round(quantile_cont({xd}, 0.5), 6) AS p50,
  round(quantile_cont({xd}, 0.75), 6) AS p75, max({xd}) AS max FROM lineitem""")
    return " UNION ALL ".join(parts)


@register("dq10_column_profile", _profile_sql())
def dq10_column_profile(spark, sf):
    p = Q.column_profile(table(spark, sf, "lineitem"), _PROFILE_NUM, _PROFILE_CAT, exact=True)
    p = p.withColumns({c: stable_round(c, 6) for c in ("mean", "std")})
    return p.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75")})


@register("dq10_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS pearson FROM lineitem"
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1:]))
def dq10_correlations(spark, sf):
    c = Q.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return c.withColumn("pearson", F.round("pearson", 6))


_EMBEDDED = 64


@register("dq10_embedding_correlations", f"""
SELECT 'e' || lpad(i::VARCHAR, 2, '0') AS column_a, 'e' || lpad(j::VARCHAR, 2, '0') AS column_b,
  round(corr(embedding[i + 1], embedding[j + 1]), 6) AS pearson
FROM embeddings, range(0, {_EMBEDDED}) AS a(i), range(0, {_EMBEDDED}) AS b(j) WHERE i < j GROUP BY ALL""")
def dq10_embedding_correlations(spark, sf):
    """All pairs of 64 columns (the components of an embedding) from one matrix."""
    e = table(spark, sf, "embeddings")
    names = [f"e{i:02d}" for i in range(_EMBEDDED)]
    wide = e.select(*[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(names)])
    return Q.correlations(wide, names).withColumn("pearson", F.round("pearson", 6))


_RANKED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("dq10_rank_correlations", "WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _RANKED) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS spearman FROM r"
                         for i, a in enumerate(_RANKED) for b in _RANKED[i + 1:]))
def dq10_rank_correlations(spark, sf):
    """Spearman correlation of every pair: mid-ranks by two-phase sums, then one matrix."""
    out = Q.rank_correlations(table(spark, sf, "lineitem"), _RANKED)
    return out.withColumn("spearman", F.round("spearman", 6))


_CROSSED = ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")


@register("dq10_associations", " UNION ALL ".join(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b, round(sqrt(greatest(sum(n * n / (na * nb)) - 1, 0)
  / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v
FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM
  (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2))"""
    for i, a in enumerate(_CROSSED) for b in _CROSSED[i + 1:]))
def dq10_associations(spark, sf):
    """Cramer's V of every pair of categorical columns, from contingency tables counted in one pass."""
    out = Q.associations(table(spark, sf, "lineitem"), _CROSSED)
    return out.withColumn("cramers_v", F.round("cramers_v", 6))


@register("dq11_target_conflict", """
SELECT l_linestatus, l_quantity, min(t) AS min_value, max(t) AS max_value, count(*) AS rows FROM
  (SELECT l_linestatus, l_quantity, (l_returnflag = 'R')::INT AS t FROM lineitem) GROUP BY 1, 2 HAVING min(t) <> max(t)""")
def dq11_target_conflict(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("t", (F.col("l_returnflag") == "R").cast("int"))
    return Q.conflicts(li, ["l_linestatus", "l_quantity"], "t")


@register("dq12_prediction_conflict", f"""
SELECT l_linestatus, l_linenumber, min(p) AS min_value, max(p) AS max_value, count(*) AS rows FROM
  (SELECT l_linestatus, l_linenumber, (prediction >= 0.5)::INT AS p FROM {PRED_SQL}) GROUP BY 1, 2 HAVING min(p) <> max(p)""")
def dq12_prediction_conflict(spark, sf):
    p = predictions(spark, sf).withColumn("p", (F.col("prediction") >= 0.5).cast("int"))
    return Q.conflicts(p, ["l_linestatus", "l_linenumber"], "p")


# ------------------------------------------------------------------ suite
_DRIFTED_SQL = _DR5_SQL + " SELECT count_if(statistic >= threshold) FROM t"


def _side(spark, sf, status):
    return quality_frame(spark, sf).where(F.col("l_linestatus") == status)


def _suite_side_sql(status):
    q = f"(SELECT * FROM {QF} WHERE l_linestatus = '{status}')"
    return f"""(SELECT ({" + ".join(f"(count_if({c} IS NULL) > 0)::INT" for c in QF_COLS)})::DOUBLE AS columns_with_missing,
  count_if({_anynull(QF_COLS)})::DOUBLE AS rows_with_missing,
  ({" + ".join(f"(min({c}) IS NOT DISTINCT FROM max({c}))::INT" for c in QF_COLS)})::DOUBLE AS constant_columns,
  (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM {q} GROUP BY {", ".join(QF_COLS)}))::DOUBLE AS duplicated_rows,
  ({" + ".join(f"bool_and({a} IS NOT DISTINCT FROM {b})::INT" for i, a in enumerate(QF_COLS) for b in QF_COLS[i + 1:]
               if _QF_TYPES[a] == _QF_TYPES[b])})::DOUBLE AS duplicated_columns FROM {q})"""


@register("dq9_test_suite", f"""
WITH cur AS {_suite_side_sql('O')}, ref AS {_suite_side_sql('F')},
c AS (UNPIVOT cur ON COLUMNS(*) INTO NAME test VALUE current),
r AS (UNPIVOT ref ON COLUMNS(*) INTO NAME test VALUE reference)
SELECT test, current, reference, reference AS "limit", current <= reference AS passed FROM c JOIN r USING (test)
UNION ALL SELECT 'columns_type', 0.0, 0.0, 0.0, true
UNION ALL SELECT 'drifted_columns', ({_DRIFTED_SQL})::DOUBLE, NULL, 2.0, ({_DRIFTED_SQL}) <= 2""")
def dq9_test_suite(spark, sf):
    """Suite over (reference = closed lines F, current = open lines O); limits default to the
    reference's values, drift is measured on the six columns of the drift table."""
    return _suite(spark, sf)


def _suite(spark, sf):
    ref, cur = _sides(spark, sf)
    drifted = dataset_drift(drift_table(ref, cur, NUM, CAT)).first()["n_drifted"]
    return Q.test_suite(_side(spark, sf, "F"), _side(spark, sf, "O"), drifted=drifted, drift_limit=(len(NUM) + len(CAT)) // 3)


@register("dq9_all_passed", f"""
WITH cur AS {_suite_side_sql('O')}, ref AS {_suite_side_sql('F')},
c AS (UNPIVOT cur ON COLUMNS(*) INTO NAME test VALUE current),
r AS (UNPIVOT ref ON COLUMNS(*) INTO NAME test VALUE reference),
t AS (SELECT current <= reference AS passed FROM c JOIN r USING (test) UNION ALL SELECT true
  UNION ALL SELECT ({_DRIFTED_SQL}) <= 2)
SELECT count(*) AS n_tests, count_if(NOT passed) AS n_failed, count_if(NOT passed) = 0 AS all_passed FROM t""")
def dq9_all_passed(spark, sf):
    """Whether every test of the suite passed."""
    return Q.all_passed(_suite(spark, sf))


# ------------------------------------------------------------------ DQ13 job
_DQ13_DECLARED = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


@register("dq13_validate_merge", """
WITH b1 AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b2 AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
s1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('1961:' || o_orderkey), o_orderkey)
  <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS part FROM b1),
s2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('1961:' || o_orderkey), o_orderkey)
  <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS part FROM b2)
SELECT * FROM s1 UNION ALL
SELECT * FROM s2 WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.o_orderkey = s2.o_orderkey AND s1.part = s2.part)""")
def dq13_validate_merge(spark, sf):
    """Two runs of the job: the first stores batch 1 (orders before 1998), the second validates
    batch 2 (orders from 1997 on), finds no drift and inserts only unseen keys per part."""
    store = scratch_path(spark, "validated-store")
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    for batch in (o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")),
                  o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))):
        # written: the job reads each part several times
        s = keep(stratified_split(batch.select(*cols), "o_orderstatus", "o_orderkey", 0.2, seed=1961, split_col="part"), "batch")
        parts = {p: s.where(F.col("part") == p) for p in ("train", "test")}
        validate_and_merge(parts, store, _DQ13_DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    stored = VersionedStore(spark, store).snapshot()
    return stored.read(spark, "train").unionByName(stored.read(spark, "test"))
