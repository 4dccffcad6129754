"""A query for each operator over the driver's tables, and the same in DuckDB's SQL.

Tables have no nulls, so some queries make them by a rule on a key. Floating results are rounded on
both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calendar, cleansing, display, features, learning, profiling
from .sources import files, runs, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls in a text and a number column, by a rule on the key."""
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )


GAPPY = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority,
CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"""


# --- cleansing

@query("""SELECT n_nationkey AS nation_key, n_name AS nation_key_1, n_regionkey AS col FROM nation""")
def clean_column_names(spark, sf_dir):
    return cleansing.clean_column_names(_table(spark, sf_dir, "nation").toDF("Nation Key!", "nation_key", "___"))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM {GAPPY}")
def drop_null_columns(spark, sf_dir):
    return cleansing.drop_null_columns(_gappy_orders(spark, sf_dir), 0.15)


@query("SELECT c_custkey, c_acctbal FROM customer")
def drop_constant_columns(spark, sf_dir):
    return cleansing.drop_constant_columns(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit("x").alias("same"), F.lit(None).cast("int").alias("none")))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_orderpriority, 'none') AS o_orderpriority, coalesce(o_totalprice, -1) AS o_totalprice FROM {GAPPY}")
def fill_nulls_by_type(spark, sf_dir):
    return cleansing.fill_nulls_by_type(_gappy_orders(spark, sf_dir), -1, "none")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def deduplicate(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return cleansing.deduplicate(lines, ["l_orderkey", "l_linenumber"], ["-l_extendedprice", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def deduplicate_plain(spark, sf_dir):
    return cleansing.deduplicate(_table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


@query(r"SELECT doc_id, md5(lower(regexp_replace(trim(text, ' '), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM documents")
def standardize_strings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleansing.standardize_strings(docs, ["text"]).select("doc_id", F.md5("text").alias("text_md5"))


FENCES = "(SELECT quantile_disc({c}, 0.25) AS q1, quantile_disc({c}, 0.75) AS q3 FROM {t})"


@query(f"SELECT event_id, value FROM events, {FENCES.format(c='value', t='events')} WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def remove_outliers_iqr(spark, sf_dir):
    return cleansing.remove_outliers(_table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) <= 2")
def remove_outliers_zscore(spark, sf_dir):
    return cleansing.remove_outliers(_table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore", z_threshold=2.0)


@query(f"SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS value FROM events, {FENCES.format(c='value', t='events')}")
def cap_outliers_iqr(spark, sf_dir):
    return _rounded(cleansing.cap_outliers(_table(spark, sf_dir, "events").select("event_id", "value"), "value"))


@query("SELECT event_id, least(greatest(value, lo), hi) AS value FROM events, (SELECT quantile_disc(value, 0.05) AS lo, quantile_disc(value, 0.95) AS hi FROM events)")
def cap_outliers_percentile(spark, sf_dir):
    return cleansing.cap_outliers(_table(spark, sf_dir, "events").select("event_id", "value"), "value", "percentile", lower_pct=0.05, upper_pct=0.95)


@query("SELECT * FROM (VALUES ('extra_cols', 'o_orderstatus'), ('missing_cols', 'o_note'), ('type_mismatches', 'o_totalprice')) t(finding, column_name)")
def validate_schema(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    found = cleansing.validate_schema(orders, {"o_orderkey": "long", "o_totalprice": "string", "o_note": "string"})
    return spark.createDataFrame([(k, c) for k, v in found.items() for c in v], "finding string, column_name string")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey::INTEGER END AS code FROM orders")
def enforce_types(spark, sf_dir):
    text = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("code"))
    return cleansing.enforce_types(text, {"o_totalprice": "double", "code": "int", "unknown": "int"})


RULES = {"quantity": "col('l_quantity').between(1, 40)", "discount": "l_discount < 0.08"}


def _rules() -> dict:
    return {"quantity": RULES["quantity"], "discount": RULES["discount"], "flag": F.when(F.col("l_linenumber") != 2, F.col("l_returnflag") != "R")}


VALID = "coalesce(l_quantity BETWEEN 1 AND 40, false) AND coalesce(l_discount < 0.08, false) AND coalesce(CASE WHEN l_linenumber <> 2 THEN l_returnflag <> 'R' END, false)"


@query(f"SELECT l_returnflag, {VALID} AS is_valid, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY ALL")
def flag_invalid_rows(spark, sf_dir):
    flagged = cleansing.flag_invalid_rows(_table(spark, sf_dir, "lineitem"), _rules())
    return flagged.groupBy("l_returnflag", "is_valid").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(f"SELECT CASE WHEN {VALID} THEN 'valid' ELSE 'invalid' END AS side, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def split_valid_invalid(spark, sf_dir):
    valid, invalid = cleansing.split_valid_invalid(_table(spark, sf_dir, "lineitem"), _rules())
    both = valid.withColumn("side", F.lit("valid")).unionByName(invalid.withColumn("side", F.lit("invalid")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def normalize_values(spark, sf_dir):
    return cleansing.normalize_values(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "done"})


# --- profiling

def _each(table: str, columns: dict[str, str], select: str) -> str:
    """The same SELECT for each column, with its place and its type."""
    return " UNION ALL ".join(select.format(c=c, t=table, kind=kind) for c, kind in columns.items())


CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query(
    _each(
        "customer",
        CUSTOMER,
        """SELECT '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, 0.0::DOUBLE AS null_pct,
count(DISTINCT {c}) AS distinct_count, CASE WHEN '{kind}' = 'double' THEN NULL ELSE min({c})::VARCHAR END AS min, CASE WHEN '{kind}' = 'double' THEN NULL ELSE max({c})::VARCHAR END AS max,
CASE WHEN '{kind}' <> 'string' THEN round(avg(try_cast({c}::VARCHAR AS DOUBLE)), 4) END AS mean, CASE WHEN '{kind}' <> 'string' THEN round(stddev_samp(try_cast({c}::VARCHAR AS DOUBLE)), 4) END AS stddev FROM {t}""",
    )
)
def profile_table(spark, sf_dir):
    report = profiling.profile_table(_table(spark, sf_dir, "customer")).drop("sample_values")
    text = F.col("data_type") != "double"  # the engines write floats as text in their own ways
    return _rounded(report.withColumns({"min": F.when(text, F.col("min")), "max": F.when(text, F.col("max"))}))


@query(_each(GAPPY, dict.fromkeys(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], ""), "SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 4) AS null_pct FROM {t}"))
def null_report(spark, sf_dir):
    return profiling.null_report(_gappy_orders(spark, sf_dir))


@query(_each("part", dict.fromkeys(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ""), "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count(*), 6) AS cardinality_ratio FROM {t}"))
def cardinality_report(spark, sf_dir):
    return profiling.cardinality_report(_table(spark, sf_dir, "part"))


@query("""SELECT o_orderpriority AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 4) AS pct FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def value_counts(spark, sf_dir):
    return profiling.value_counts(_table(spark, sf_dir, "orders"), "o_orderpriority")


SUMMARY = """SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, min({c})::DOUBLE AS min, quantile_disc({c}, 0.25)::DOUBLE AS p25,
quantile_disc({c}, 0.5)::DOUBLE AS p50, quantile_disc({c}, 0.75)::DOUBLE AS p75, max({c})::DOUBLE AS max,
round(skewness({c}) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis FROM {t}"""


@query(_each("lineitem", dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ""), SUMMARY))
def numeric_summary(spark, sf_dir):
    return _rounded(profiling.numeric_summary(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS pearson_correlation FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlation_matrix(spark, sf_dir):
    return _rounded(profiling.correlation_matrix(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 6)


@query(f"""SELECT event_id, round(q1 - 1.5 * (q3 - q1), 4) AS iqr_lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS iqr_upper_bound,
value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events, {FENCES.format(c='value', t='events')}""")
def detect_outliers_iqr(spark, sf_dir):
    return _rounded(profiling.detect_outliers_iqr(_table(spark, sf_dir, "events").select("event_id", "value"), "value").drop("value"))


OTHER = "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 17 = 0)"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS {OTHER}
SELECT *, 'only_in_df1' AS diff_type, 'df1' AS source FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)
UNION ALL SELECT *, 'only_in_df2', 'df2' FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
UNION ALL SELECT a.*, 'changed', 'df1' FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus
UNION ALL SELECT b.*, 'changed', 'df2' FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus""")
def compare_dataframes(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    other = orders.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    other = other.unionByName(orders.where("o_orderkey % 17 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    return profiling.compare_dataframes(orders, other, ["o_orderkey"])


@query("""SELECT * FROM (VALUES ('n_name', 'unchanged', 'string', 'string'), ('n_nationkey', 'type_changed', 'int', 'bigint'), ('n_regionkey', 'removed', 'int', NULL), ('n_note', 'added', NULL, 'string')) t(column_name, status, type_in_df1, type_in_df2)""")
def schema_diff(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    return profiling.schema_diff(nation, nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit("").alias("n_note")))


@query(f"""WITH s AS (SELECT count(*) AS n, (count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_orderpriority) + count(o_totalprice)) / (5 * count(*)) * 100 AS completeness,
((count(DISTINCT o_orderkey) / count(*) > 0.01)::INT + (count(DISTINCT o_custkey) / count(*) > 0.01)::INT + (count(DISTINCT o_orderstatus) / count(*) > 0.01)::INT + (count(DISTINCT o_orderpriority) / count(*) > 0.01)::INT + (count(DISTINCT o_totalprice) / count(*) > 0.01)::INT) / 5 * 100 AS uniqueness,
100.0::DOUBLE AS validity FROM {GAPPY})
SELECT n AS total_rows, 5 AS total_columns, round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(validity, 4) AS validity, round((completeness + uniqueness + validity) / 3, 4) AS overall FROM s""")
def data_quality_score(spark, sf_dir):
    return profiling.data_quality_score(_gappy_orders(spark, sf_dir))


# --- calendar

@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def parse_dates(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "yyyyMMdd")).otherwise("not a date")
    return calendar.parse_dates(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), "day")


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS d_year, month(o_orderdate)::INT AS d_month, day(o_orderdate)::INT AS d_day, quarter(o_orderdate)::INT AS d_quarter,
(dayofweek(o_orderdate) + 1)::INT AS d_day_of_week, dayofyear(o_orderdate)::INT AS d_day_of_year, weekofyear(o_orderdate)::INT AS d_week_of_year FROM orders""")
def add_date_parts(spark, sf_dir):
    return calendar.add_date_parts(_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")


@query("SELECT event_id, hour(ts)::INT AS ts_hour, minute(ts)::INT AS ts_minute, second(ts)::INT AS ts_second FROM events")
def add_time_parts(spark, sf_dir):
    return calendar.add_time_parts(_table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


MONTHS = """((year({a}) - year({b})) * 12 + month({a}) - month({b}) + CASE WHEN day({a}) = day({b}) OR ({a}::DATE = last_day({a}) AND {b}::DATE = last_day({b})) THEN 0 ELSE (day({a}) - day({b})) / 31.0 END)"""


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, (l_shipdate::DATE - o_orderdate::DATE)::INT AS o_orderdate_to_l_shipdate_diff_days,
trunc({MONTHS.format(a='l_shipdate', b='o_orderdate')})::INT AS o_orderdate_to_l_shipdate_diff_months,
trunc(date_diff('second', o_orderdate, l_shipdate) / 3600)::BIGINT AS o_orderdate_to_l_shipdate_diff_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_diff_columns(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")
    for units in ("days", "months", "hours"):
        lines = calendar.date_diff_columns(lines, "o_orderdate", "l_shipdate", units)
    return lines.drop("o_orderdate", "l_shipdate")


@query("""SELECT o_orderkey, (d + (7 + CASE WHEN isodow(d) > 4 THEN 3 ELSE 1 END)::INT)::DATE AS due FROM (SELECT o_orderkey, CASE isodow(o_orderdate) WHEN 6 THEN o_orderdate::DATE - 1 WHEN 7 THEN o_orderdate::DATE - 2 ELSE o_orderdate::DATE END AS d FROM orders)""")
def add_business_days(spark, sf_dir):
    return calendar.add_business_days(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 6, "due").drop("o_orderdate")


@query("SELECT o_orderkey, isodow(o_orderdate) < 6 AS o_orderdate_is_business_day FROM orders")
def is_business_day(spark, sf_dir):
    return calendar.is_business_day(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("SELECT unnest(range(DATE '2024-01-01', DATE '2024-03-02', INTERVAL 7 DAY))::DATE AS week_start")
def generate_date_spine(spark, sf_dir):
    return calendar.generate_date_spine(spark, "2024-01-01", "2024-03-01", "week")


@query("""WITH d AS (SELECT user_id, ts::DATE AS date, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL),
spine AS (SELECT unnest(range(min(date), max(date) + 1, INTERVAL 1 DAY))::DATE AS date FROM d)
SELECT p.user_id, s.date, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM spine s CROSS JOIN (SELECT DISTINCT user_id FROM d) p LEFT JOIN d USING (date, user_id)""")
def fill_date_gaps(spark, sf_dir):
    daily = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return calendar.fill_date_gaps(daily, "day", "user_id")


@query("SELECT o_orderkey, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END)::INT AS fiscal_year FROM orders")
def add_fiscal_year(spark, sf_dir):
    return calendar.add_fiscal_year(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 10).drop("o_orderdate")


@query(f"SELECT o_orderkey, floor({MONTHS.format(a=chr(68) + 'ATE ' + chr(39) + '2030-06-15' + chr(39), b='o_orderdate')} / 12)::INT AS age_years FROM orders")
def add_age(spark, sf_dir):
    return calendar.add_age(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "2030-06-15").drop("o_orderdate")


@query(f"""SELECT event_id, trunc((epoch(TIMESTAMP '2025-01-01')::BIGINT - floor(epoch(ts))::BIGINT) / 3600)::BIGINT AS ts_since_hours,
(DATE '2025-01-01' - ts::DATE)::INT AS ts_since_days FROM events""")
def add_time_since(spark, sf_dir):
    events = calendar.add_time_since(_table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "2025-01-01", "hours")
    return calendar.add_time_since(events, "ts", "2025-01-01", "days").drop("ts")


@query("SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day FROM events")
def bucket_time_of_day(spark, sf_dir):
    return calendar.bucket_time_of_day(_table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


# --- display

@query(
    _each(
        "region",
        {"r_regionkey": "IntegerType()", "r_name": "StringType()"},
        "SELECT '{c}' AS column, '{kind}' AS data_type, true AS nullable, count(*) - count({c}) AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT {c}) AS distinct_count FROM {t}",
    )
)
def summary_table(spark, sf_dir):
    return display.summary_table(_table(spark, sf_dir, "region")).drop("sample_values")


@query("""SELECT * FROM (VALUES ('n_name', true, false, 'StringType()', '', false), ('n_nationkey', true, false, 'IntegerType()', '', false), ('n_regionkey', true, false, 'IntegerType()', '', false),
('r_name', false, true, '', 'StringType()', false), ('r_regionkey', false, true, '', 'IntegerType()', false)) t("column", in_nation, in_region, type_nation, type_region, types_match)""")
def compare_side_by_side(spark, sf_dir):
    return display.compare_side_by_side(_table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region"), "nation", "region")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 0) AS l_extendedprice FROM lineitem")
def format_number_columns(spark, sf_dir):
    return display.format_number_columns(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_extendedprice"], 0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', round(l_discount * 100, 1)) AS l_discount FROM lineitem")
def format_pct_columns(spark, sf_dir):
    return display.format_pct_columns(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), ["l_discount"])


@query("SELECT count(*) AS n, count(*) AS distinct_numbers FROM lineitem")
def add_row_numbers(spark, sf_dir):
    return display.add_row_numbers(_table(spark, sf_dir, "lineitem").select("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_num").alias("distinct_numbers"))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1")
def pivot_summary(spark, sf_dir):
    return _rounded(display.pivot_summary(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice"), 2)


@query("""SELECT o_orderpriority, count(o_orderkey) FILTER (o_orderstatus = 'F') AS "F", count(o_orderkey) FILTER (o_orderstatus = 'O') AS "O", count(o_orderkey) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_summary_wide(spark, sf_dir):
    return display.pivot_summary(_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "count", "o_orderstatus").fillna(0)


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS w FROM events),
c AS (SELECT least(floor((value - lo) / w), 19)::INT AS bin_index, count(*) AS count FROM events, e GROUP BY 1)
SELECT b::INT AS bin_index, round(lo + b * w, 4) AS bin_start, round(CASE WHEN b = 19 THEN hi ELSE lo + (b + 1) * w END, 4) AS bin_end, coalesce(count, 0) AS count FROM range(20) r(b) CROSS JOIN e LEFT JOIN c ON c.bin_index = b""")
def histogram_data(spark, sf_dir):
    return _rounded(display.histogram_data(_table(spark, sf_dir, "events"), "value"))


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3""")
def top_n_by_group(spark, sf_dir):
    return display.top_n_by_group(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 3, ties=["o_orderkey"])


@query("""SELECT o_orderstatus AS o_orderstatus_o_orderpriority, """ + ", ".join(f"""round(count(*) FILTER (o_orderpriority = '{p}') / any_value(n) * 100, 2) AS "{p}" """ for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + """ FROM orders, (SELECT count(*) AS n FROM orders) GROUP BY 1""")
def crosstab_pct(spark, sf_dir):
    return display.crosstab_pct(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


# --- features

@query("""SELECT o_orderkey, i::DOUBLE AS o_orderpriority_indexed FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1) USING (o_orderpriority)""")
def encode_categoricals(spark, sf_dir):
    return features.encode_categoricals(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])[0].drop("o_orderpriority")


@query("""WITH i AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS i FROM orders GROUP BY 1)
SELECT o_orderkey, (i = 0)::INT AS h0, (i = 1)::INT AS h1, (i = 2)::INT AS h2 FROM orders JOIN i USING (o_orderstatus)""")
def encode_onehot(spark, sf_dir):
    hot = vector_to_array("o_orderstatus_onehot")
    coded = features.encode_categoricals(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "onehot")[0]
    return coded.select("o_orderkey", *(F.coalesce(F.get(hot, F.lit(k)), F.lit(0.0)).cast("int").alias(f"h{k}") for k in range(3)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("u"))
    return VectorAssembler(inputCols=["value", "u"], outputCol="v").transform(events)


def _scaled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    out = vector_to_array("scaled_features")
    return features.scale_features(_vectors(spark, sf_dir), "v", method=method)[0].select("event_id", *(F.round(out[i], 6).alias(f"s{i}") for i in range(2)))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS s0, round((user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER (), 6) AS s1 FROM events")
def scale_features_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS s0, round((user_id - min(user_id) OVER ()) / (max(user_id) OVER () - min(user_id) OVER ())::DOUBLE, 6) AS s1 FROM events")
def scale_features_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("SELECT event_id, round(value / max(abs(value)) OVER (), 6) AS s0, round(user_id / (max(abs(user_id)) OVER ())::DOUBLE, 6) AS s1 FROM events")
def scale_features_maxabs(spark, sf_dir):
    return _scaled(spark, sf_dir, "maxabs")


@query("SELECT o_orderkey, o_custkey::DOUBLE AS a0, o_totalprice AS a1 FROM orders WHERE o_orderkey % 5 <> 0")
def assemble_features(spark, sf_dir):
    rows = features.assemble_features(_gappy_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_totalprice"])
    return rows.select("o_orderkey", *(vector_to_array("features")[i].alias(f"a{i}") for i in range(2)))


@query("SELECT p_partkey, (CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END)::DOUBLE AS size_bin FROM part")
def create_bins_custom(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return features.create_bins(part, "p_size", "custom", custom_splits=[float("-inf"), 10, 25, float("inf")], output_col="size_bin").drop("p_size")


@query()
def create_bins_quantile(spark, sf_dir):
    return features.create_bins(_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS d_year, month(o_orderdate)::INT AS d_month, day(o_orderdate)::INT AS d_day, (dayofweek(o_orderdate) + 1)::INT AS d_day_of_week,
quarter(o_orderdate)::INT AS d_quarter, (isodow(o_orderdate) > 5)::INT AS d_is_weekend FROM orders""")
def add_date_features(spark, sf_dir):
    return features.add_date_features(_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")), "d").drop("d")


@query("SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS o_totalprice_lag_1, lag(o_totalprice, 3) OVER w AS o_totalprice_lag_3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def add_lag_features(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return features.add_lag_features(orders, "o_totalprice", "o_custkey", ["o_orderdate", "o_orderkey"], [1, 3]).select("o_orderkey", "o_totalprice_lag_1", "o_totalprice_lag_3")


@query("SELECT o_orderkey, " + ", ".join(f"round({sql}(o_totalprice) OVER w, 4) AS o_totalprice_rolling_{f}_3" for f, sql in (("avg", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"))) + " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def add_rolling_features(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rolled = features.add_rolling_features(orders, "o_totalprice", "o_custkey", ["o_orderdate", "o_orderkey"], [3], ["avg", "min", "max", "sum"])
    return _rounded(rolled.drop("o_custkey", "o_orderdate", "o_totalprice"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_discount, 4) AS l_extendedprice_x_l_discount FROM lineitem")
def add_interaction_features(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    return _rounded(features.add_interaction_features(lines, [("l_extendedprice", "l_discount")]).drop("l_extendedprice", "l_discount"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS tax_ratio FROM lineitem")
def add_ratio_features(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    return _rounded(features.add_ratio_features(lines, [("l_tax", "l_discount", "tax_ratio")]).drop("l_tax", "l_discount"), 6)


@query(f"SELECT o_orderkey, (o_orderpriority IS NULL)::INT AS o_orderpriority_missing, (o_totalprice IS NULL)::INT AS o_totalprice_missing FROM {GAPPY}")
def add_missing_indicators(spark, sf_dir):
    return features.add_missing_indicators(_gappy_orders(spark, sf_dir)).select("o_orderkey", "o_orderpriority_missing", "o_totalprice_missing")


@query(f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_disc(o_totalprice, 0.5) FROM {GAPPY})) AS o_totalprice FROM {GAPPY}")
def impute_columns_median(spark, sf_dir):
    return features.impute_columns(_gappy_orders(spark, sf_dir), "median", ["o_totalprice"])[0].select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, round(coalesce(o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderstatus)), 4) AS o_totalprice FROM {GAPPY}")
def impute_columns_by_group(spark, sf_dir):
    return _rounded(features.impute_columns(_gappy_orders(spark, sf_dir), "mean", ["o_totalprice"], "o_orderstatus")[0].select("o_orderkey", "o_totalprice"))


@query(f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {GAPPY} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {GAPPY}""")
def impute_columns_mode(spark, sf_dir):
    return features.impute_columns(_gappy_orders(spark, sf_dir), "mode", ["o_orderpriority"])[0].select("o_orderkey", "o_orderpriority")


@query(f"""WITH g AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_disc(o_totalprice, 0.5) FROM {GAPPY})) AS p FROM {GAPPY})
SELECT o_orderkey, round((p - avg(p) OVER ()) / stddev_samp(p) OVER (), 6) AS first_feature FROM g""")
def prepare_features(spark, sf_dir):
    out, _ = features.prepare_features(_gappy_orders(spark, sf_dir), ["o_totalprice"], ["o_orderstatus"])
    return out.select("o_orderkey", F.round(vector_to_array("scaled_features")[0], 6).alias("first_feature"))


# --- learning

@query("SELECT count(*) AS n, count(*) AS n_apart, true AS near_share FROM orders")
def split_data(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    parts = learning.split_data(orders, [0.7, 0.3], 42, "o_orderstatus")
    marked = parts[0].select("o_orderkey", F.lit(0).alias("part")).unionByName(parts[1].select("o_orderkey", F.lit(1).alias("part")))
    return marked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_apart"), F.avg("part").between(0.29, 0.31).alias("near_share"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a label and a guess that a rule on the keys makes, and a probability."""
    lines = _table(spark, sf_dir, "lineitem")
    label = (F.col("l_quantity") > 25).cast("double")
    guess = F.when(F.col("l_partkey") % 7 == 0, 1 - label).otherwise(label)
    return lines.select(label.alias("label"), guess.alias("prediction"), (F.col("l_quantity") / 50 * 0.8 + F.col("l_discount")).alias("p"), "l_extendedprice", "l_tax")


JUDGED = "(SELECT (l_quantity > 25)::INT AS label, CASE WHEN l_partkey % 7 = 0 THEN 1 - (l_quantity > 25)::INT ELSE (l_quantity > 25)::INT END AS prediction, l_quantity / 50 * 0.8 + l_discount AS p, l_extendedprice, l_tax FROM lineitem)"


@query(f"""WITH m AS (SELECT label, prediction, count(*) AS n FROM {JUDGED} GROUP BY ALL), c AS (SELECT l.label, l.s, l.h, l.h / g.s AS p, l.h / l.s AS r FROM
(SELECT label, sum(n) AS s, sum(n) FILTER (label = prediction) AS h FROM m GROUP BY 1) l JOIN (SELECT prediction, sum(n) AS s FROM m GROUP BY 1) g ON l.label = g.prediction)
SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(2 * p * r / (p + r) * s) / sum(s), 6) AS f1, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall FROM c""")
def classification_report(spark, sf_dir):
    return _rounded(learning.classification_metrics(_judged(spark, sf_dir)), 6)


@query(f"SELECT label::DOUBLE AS label, prediction::DOUBLE AS prediction, count(*) AS count FROM {JUDGED} GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return learning.confusion_matrix(_judged(spark, sf_dir))


@query("""WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)
SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(e * e), 1) AS mse, round(avg(abs(e)), 3) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg(abs(e) / abs(y)), 6) AS mape FROM e""")
def regression_report(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    places = {"rmse": 3, "mse": 1, "mae": 3, "r2": 6, "mape": 6}
    return learning.regression_metrics(lines).select(*(F.round(k, n).alias(k) for k, n in places.items()))


@query(f"""WITH t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (label = 1 AND p >= threshold) AS tp, count(*) FILTER (label = 0 AND p >= threshold) AS fp,
count(*) FILTER (label = 1 AND p < threshold) AS fn, count(*) FILTER (label = 0 AND p < threshold) AS tn FROM {JUDGED}, t GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def find_best_threshold(spark, sf_dir):
    return _rounded(learning.find_best_threshold(_judged(spark, sf_dir), "label", "p")[0], 6)


@query("""SELECT doc_id, quality, (SELECT count(*) FROM labels) / (2 * count(*) OVER (PARTITION BY quality)) AS class_weight FROM labels""")
def class_weight(spark, sf_dir):
    return learning.handle_class_imbalance(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "weight")


@query()
def oversample(spark, sf_dir):
    return learning.handle_class_imbalance(_table(spark, sf_dir, "labels"), "quality", "oversample")


@query()
def undersample(spark, sf_dir):
    return learning.handle_class_imbalance(_table(spark, sf_dir, "labels"), "quality", "undersample")


def _model(spark: SparkSession, sf_dir: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    rows = _judged(spark, sf_dir).select("label", "p", "l_tax")
    return Pipeline(stages=[VectorAssembler(inputCols=["p", "l_tax"], outputCol="features"), LogisticRegression(maxIter=5)]), rows


@query()
def train_and_compare_models(spark, sf_dir):
    pipeline, rows = _model(spark, sf_dir)
    train, test = learning.split_data(rows)
    return learning.compare_models({"logistic": pipeline}, train, test)


@query()
def train_and_evaluate(spark, sf_dir):
    pipeline, rows = _model(spark, sf_dir)
    train, test = learning.split_data(rows)
    found = learning.train_and_evaluate(pipeline, train, test)
    return spark.createDataFrame([(k, float(v)) for k, v in found["metrics"].items()], "metric string, value double")


@query()
def feature_importance(spark, sf_dir):
    pipeline, rows = _model(spark, sf_dir)
    return learning.feature_importance(pipeline.fit(rows), ["p", "l_tax"])


@query()
def cross_validate(spark, sf_dir):
    pipeline, rows = _model(spark, sf_dir)
    return learning.cross_validate(pipeline, rows, num_folds=2)["per_fold_metrics"]


# --- tables

@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def read_table_filtered(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("loomframe_orders")
    return tables.read_table_safe(spark, "loomframe_orders", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F' and o_totalprice > 100000")


@query("""SELECT c.c_custkey, c.c_name, CASE WHEN c.c_custkey % 10 = 0 THEN c.c_acctbal + 1 ELSE c.c_acctbal END AS c_acctbal FROM customer c
UNION ALL SELECT -c_custkey - 1, c_name, c_acctbal FROM customer WHERE c_custkey % 25 = 0""")
def merge_into(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = customer.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    source = source.unionByName(customer.where("c_custkey % 25 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1))
    return tables.merged(customer, source, "c_custkey")


@query("""SELECT c_custkey, c_mktsegment, DATE '2024-01-01' AS effective_date, CASE WHEN c_custkey % 10 = 0 AND c_mktsegment <> 'NEW' THEN DATE '2024-06-01' END AS end_date, NOT (c_custkey % 10 = 0 AND c_mktsegment <> 'NEW') AS is_current FROM customer
UNION ALL SELECT c_custkey, 'NEW', DATE '2024-06-01', NULL, true FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT -c_custkey - 1, c_mktsegment, DATE '2024-06-01', NULL, true FROM customer WHERE c_custkey % 25 = 0""")
def scd_type2(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    target = customer.withColumns({"effective_date": F.to_date(F.lit("2024-01-01")), "end_date": F.lit(None).cast("date"), "is_current": F.lit(True)})
    source = customer.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW")).unionByName(customer.where("c_custkey % 25 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1))
    return tables.scd2(target, source, "c_custkey", ["c_mktsegment"], F.to_date(F.lit("2024-06-01")))


# --- written and read back: tables, files, the run store

def _name(what: str) -> str:
    return f"loomframe_{what}_{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession, what: str) -> str:
    """A new folder where the session keeps shared files."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{_name(what)}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def write_table(spark, sf_dir):
    orders, name = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _name("orders")
    tables.write_table(orders, name, partition_by="o_orderstatus")
    tables.write_table(orders.where("o_orderstatus = 'F'"), name, "append", "o_orderstatus")
    return tables.read_table_safe(spark, name)


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS c_mktsegment FROM customer")
def read_csv_with_schema(spark, sf_dir):
    path = _folder(spark, "csv")
    files.write_to_volume(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return files.read_csv_with_schema(spark, path, "c_custkey long, c_name string, c_mktsegment string", null_values=["BUILDING", "MACHINERY"])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def read_files_from_volume(spark, sf_dir):
    path = _folder(spark, "json")
    files.write_to_volume(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path, "json")
    return files.read_files_from_volume(spark, path, "json")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def write_to_volume(spark, sf_dir):
    rows, path = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _folder(spark, "parquet")
    for mode in ("overwrite", "append"):
        files.write_to_volume(rows, path, "parquet", mode)
    return files.read_files_from_volume(spark, path, "parquet")


@query("""SELECT 'before' AS step, false AS is_there, NULL::BIGINT AS row_count, NULL::BIGINT AS column_count, '' AS partitioned_by
UNION ALL SELECT 'created', true, count(*), 3, 'p_brand' FROM part UNION ALL SELECT 'created again', false, count(*), 3, 'p_brand' FROM part
UNION ALL SELECT 'listed', true, 1, NULL, '' UNION ALL SELECT 'backup', true, count(*), 3, 'p_brand' FROM part""")
def table_catalog(spark, sf_dir):
    part, name = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), _name("part")

    def described(step: str, is_there: bool, table: str) -> tuple:
        info = tables.get_table_info(spark, table)
        return step, is_there, info["row_count"], info["column_count"], ",".join(info["partitioned_by"])

    rows = [("before", tables.table_exists(spark, name), None, None, "")]
    for step in ("created", "created again"):
        rows.append(described(step, tables.create_table_if_not_exists(spark, part, name, "p_brand", "parts, by brand"), name))
    listed = tables.list_tables(spark, pattern=name)
    rows.append(("listed", [t["name"] for t in listed] == [name], len(listed), None, ""))
    copy = tables.backup_table(spark, name, "_copy")
    rows.append(described("backup", tables.table_exists(spark, copy), copy))
    return spark.createDataFrame(rows, "step string, is_there boolean, row_count long, column_count long, partitioned_by string")


@query("SELECT p_partkey, p_name, p_brand FROM part")
def backup_table(spark, sf_dir):
    name = _name("part")
    tables.write_table(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), name, partition_by="p_brand")
    return spark.table(tables.backup_table(spark, name, "_copy"))


@query(ORACLE_SQL["merge_into"])
def merge_into_table(spark, sf_dir):
    customer, name = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _name("customer")
    tables.write_table(customer, name)
    source = customer.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    source = source.unionByName(customer.where("c_custkey % 25 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1))
    tables.merge_into(spark, name, source, "c_custkey")
    return spark.table(name)


@query("""SELECT c_custkey, c_mktsegment, NOT (c_custkey % 10 = 0 AND c_mktsegment <> 'NEW') AS is_current, c_custkey % 10 = 0 AND c_mktsegment <> 'NEW' AS is_closed FROM customer
UNION ALL SELECT c_custkey, 'NEW', true, false FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -c_custkey - 1, c_mktsegment, true, false FROM customer WHERE c_custkey % 25 = 0""")
def scd_type2_table(spark, sf_dir):
    customer, name = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _name("dimension")
    tables.write_table(customer.withColumns({"effective_date": F.to_date(F.lit("2024-01-01")), "end_date": F.lit(None).cast("date"), "is_current": F.lit(True)}), name)
    source = customer.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW")).unionByName(customer.where("c_custkey % 25 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1))
    tables.scd_type2(spark, name, source, "c_custkey", ["c_mktsegment"])
    return spark.table(name).select("c_custkey", "c_mktsegment", "is_current", F.col("end_date").isNotNull().alias("is_closed"))


def _logged_regions(spark: SparkSession, sf_dir: str) -> str:
    """A new run store with a run for each region, its key as a metric; the experiment."""
    runs.set_store(_folder(spark, "runs"))
    runs.setup_experiment("regions", {"kind": "test"})
    for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        runs.log_run(None, {"accuracy": r["r_regionkey"] / 10, "size": len(r["r_name"])}, {"name": r["r_name"]}, {"note.txt": r["r_name"]}, {"of": "region"}, None, r["r_name"], "regions")
    return "regions"


@query("""SELECT r_name AS run_name, r_regionkey / 10 AS accuracy, length(r_name)::DOUBLE AS size, 'region' AS tag, r_name AS note FROM region""")
def log_run(spark, sf_dir):
    experiment = _logged_regions(spark, sf_dir)
    known = runs.runs().where(F.col("experiment_id") == runs.setup_experiment(experiment))
    notes = runs._log("artifacts", runs._ARTIFACTS).select("run_id", F.col("content").alias("note"))
    return known.join(notes, "run_id").select("run_name", F.col("metrics.accuracy").alias("accuracy"), F.col("metrics.size").alias("size"), F.col("tags.of").alias("tag"), "note")


@query("""SELECT 'best' AS what, (SELECT r_name FROM region ORDER BY r_regionkey DESC LIMIT 1) AS value UNION ALL SELECT 'best by name length', (SELECT r_name FROM region ORDER BY length(r_name), r_regionkey DESC LIMIT 1)
UNION ALL SELECT 'compared', count(*)::VARCHAR FROM region UNION ALL SELECT 'beyond three', greatest(0, count(*) - 3)::VARCHAR FROM region UNION ALL SELECT 'left', least(3, count(*))::VARCHAR FROM region""")
def run_reports(spark, sf_dir):
    experiment = _logged_regions(spark, sf_dir)
    rows = [("best", runs.get_best_run(experiment)["run_name"]), ("best by name length", runs.get_best_run(experiment, metric="metrics.size", ascending=True)["run_name"])]
    rows.append(("compared", str(len(runs.get_run_comparison(experiment)))))
    rows.append(("beyond three", str(len(runs.cleanup_runs(experiment, keep_top_n=3, delete=True)))))
    rows.append(("left", str(len(runs.get_run_comparison(experiment)))))
    return spark.createDataFrame(rows, "what string, value string")


@query("""SELECT * FROM (VALUES ('grid', NULL, 'a parent'), ('child', 0.5::DOUBLE, '1'), ('child', 0.75::DOUBLE, '2')) t(kind, metric, value)""")
def log_grid_search(spark, sf_dir):
    from types import SimpleNamespace

    runs.set_store(_folder(spark, "runs"))
    parent = runs.log_grid_search(SimpleNamespace(avgMetrics=[0.5, 0.75]), [{"depth": 1}, {"depth": 2}], "grids", "grid")
    child = F.col("parent_run_id") == parent
    return runs.runs().where(child | (F.col("run_id") == parent)).select(
        F.when(child, "child").otherwise("grid").alias("kind"), F.col("metrics.avg_cv_metric").alias("metric"), F.when(child, F.col("params.depth")).otherwise("a parent").alias("value")
    )


@query("""SELECT 'snapshot_nations' AS run_name, count(*)::DOUBLE AS n_rows, 2 AS n_artifacts FROM nation""")
def log_data_snapshot(spark, sf_dir):
    runs.set_store(_folder(spark, "runs"))
    run_id = runs.log_data_snapshot(_table(spark, sf_dir, "nation"), "nations", 10)
    n = runs.artifacts(run_id).count()
    return runs.runs().where(F.col("run_id") == run_id).select("run_name", F.col("metrics.rows").alias("n_rows"), F.lit(n).alias("n_artifacts"))


def _saved_models(spark: SparkSession) -> None:
    """A new run store with two versions of a model, the second the champion."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    runs.set_store(_folder(spark, "runs"))
    for factor in (2, 3):
        stage = SQLTransformer(statement=f"SELECT *, CAST(label * {factor} AS DOUBLE) AS prediction FROM __THIS__")
        runs.log_run_to_mlflow(Pipeline(stages=[stage]).fit(spark.range(1)), {"factor": factor}, {"factor": factor}, None, "multiples")
    runs.promote_model("multiples")


@query("SELECT o_orderkey, o_totalprice AS label, round(o_totalprice * 3, 4) AS prediction FROM orders")
def batch_predict(spark, sf_dir):
    _saved_models(spark)
    return _rounded(learning.batch_predict("models:/multiples@champion", _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("label"))))


@query("SELECT v::VARCHAR AS version, round(sqrt(avg((o_totalprice * v) ** 2)), 2) AS rmse, round(avg(abs(o_totalprice * v)), 2) AS mae FROM orders, (VALUES (1), (2)) t(v) GROUP BY v")
def compare_model_versions(spark, sf_dir):
    _saved_models(spark)
    found = runs.compare_model_versions("multiples", 1, 2, _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("label")), task="regression")
    return spark.createDataFrame([(v, round(float(r["rmse"]), 2), round(float(r["mae"]), 2)) for v, r in found.iterrows()], "version string, rmse double, mae double")
