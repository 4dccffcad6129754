"""Profiling and comparing tables.

A report over any number of columns is one aggregate over one scan (two for the full profile, whose
distinct counts are apart), unpivoted lazily: no job runs until the report itself is used. Distinct counts are exact unless ``approx`` is set; quantiles are
sketches of bounded size whose rank error is ``1 / accuracy``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import is_numeric, is_orderable, named, numeric_columns, require_columns, require_frame, unpivoted, without_nan

SAMPLES = 5
ACCURACY = 200_000


def _session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _distinct(c: Column, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def sample_values(c: Column, kind_ok: bool, n: int = SAMPLES) -> Column:
    """Up to ``n`` distinct values as text: the least and greatest of each of ``n`` hash classes, so of bounded size."""
    if not kind_ok:
        return F.lit(None).cast("string")
    text = c.cast("string")
    mine = [F.when(F.pmod(F.xxhash64(text), F.lit(n)) == i, text) for i in range(n)]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*(f(m) for m in mine for f in (F.min, F.max))))))
    return F.array_join(F.slice(found, 1, n), ", ")


def profile_table(df: DataFrame, sample_size: int | None = None, approx: bool = False) -> DataFrame:
    """A row for each column: type, counts of null and distinct values, extremes, mean, spread and sample values.

    ``sample_size`` profiles a Bernoulli sample of about so many rows (seed 42), which counts the
    rows first. Nested columns have null for what needs an order. An empty table gives no rows.
    """
    require_frame(df)
    if sample_size is not None:
        total = df.count()
        if total > sample_size:
            df = df.sample(False, sample_size / total, 42)
    per = {}
    for f in df.schema.fields:
        c, ordered, number = named(f.name), is_orderable(f.dataType), is_numeric(f.dataType)
        text, none = F.lit(None).cast("string"), F.lit(None).cast("double")
        per[f.name] = {
            "data_type": F.first(F.lit(f.dataType.simpleString())),
            "non_null_count": F.count(c),
            "min": F.min(c).cast("string") if ordered else F.max(text),
            "max": F.max(c).cast("string") if ordered else F.max(text),
            "mean": F.mean(c.cast("double")) if number else F.max(none),
            "stddev": F.stddev(c.cast("double")) if number else F.max(none),
            "sample_values": sample_values(c, ordered) if ordered else F.max(text),
        }
    rows = unpivoted(df, per, {"n": F.count(F.lit(1))}).where("n > 0")
    # distinct counts are an aggregate of their own: beside them, text extremes would be sorted once for each distinct value
    distinct = {f.name: _distinct(named(f.name), approx) if is_orderable(f.dataType) else F.max(F.lit(None).cast("long")) for f in df.schema.fields}
    counts = df.agg(F.array(*distinct.values()).alias("_counts"))
    rows = rows.crossJoin(F.broadcast(counts)).withColumn("distinct_count", F.get("_counts", F.col("_at")))
    nulls = F.col("n") - F.col("non_null_count")
    return rows.select(
        "column_name", "data_type", "non_null_count", nulls.alias("null_count"), F.round(nulls / F.col("n") * 100, 4).alias("null_pct"),
        "distinct_count", "min", "max", "mean", "stddev", "sample_values",
    )


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percentage of each column, most first (ties in column order); no rows for an empty table."""
    require_frame(df)
    rows = unpivoted(df, {c: {"null_count": F.count_if(named(c).isNull())} for c in df.columns}, {"n": F.count(F.lit(1))}).where("n > 0")
    pct = F.round(F.col("null_count") / F.col("n") * 100, 4)
    return rows.withColumn("null_pct", pct).orderBy(F.desc("null_pct"), "_at").select("column_name", "null_count", "null_pct")


def cardinality_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct values of each column and their share of the rows, most first; nested columns are counted as JSON."""
    require_frame(df)
    keys = {f.name: named(f.name) if is_orderable(f.dataType) else F.to_json(F.struct(named(f.name))) for f in df.schema.fields}
    rows = unpivoted(df, {c: {"distinct_count": _distinct(k, approx)} for c, k in keys.items()}, {"n": F.count(F.lit(1))}).where("n > 0")
    ratio = F.round(F.col("distinct_count") / F.col("n"), 6)
    return rows.withColumn("cardinality_ratio", ratio).orderBy(F.desc("cardinality_ratio"), "_at").select("column_name", "distinct_count", "cardinality_ratio")


def value_counts(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """The ``top_n`` most frequent values as text with count and percentage of all rows; null is a value, ties go by value."""
    require_frame(df)
    require_columns(df, column)
    counts = df.groupBy(named(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__n"))  # of the same counts, which are shuffled once
    rows = counts.orderBy(F.desc("count"), F.col("value").asc_nulls_last()).limit(top_n).crossJoin(F.broadcast(total))
    return rows.select("value", "count", F.round(F.col("count") / F.col("__n") * 100, 4).alias("pct")).orderBy(F.desc("count"), F.col("value").asc_nulls_last())


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Moments and quartiles of each numeric column; skewness and excess kurtosis of the population; NaN is left out.

    Columns without a value, or a table without rows, give null statistics.
    """
    require_frame(df)
    wanted = numeric_columns(df, columns)
    names = ("mean", "stddev", "min", "p25", "p50", "p75", "max", "skewness", "kurtosis")
    if not wanted:
        return _session(df).createDataFrame([], "column_name string, " + ", ".join(f"{n} double" for n in names))

    def metrics(c: str) -> dict[str, Column]:
        x = without_nan(df, c).cast("double")
        return {
            "mean": F.mean(x), "stddev": F.stddev(x), "min": F.min(x), "q": F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy),
            "max": F.max(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x),
        }

    rows = unpivoted(df, {c: metrics(c) for c in wanted}, {"n": F.count(F.lit(1))}).where("n > 0")
    quartile = {"p25": F.col("q")[0], "p50": F.col("q")[1], "p75": F.col("q")[2]}
    return rows.select("column_name", *(quartile.get(n, F.col(n)).alias(n) for n in names))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each pair of numeric columns, strongest first, over rows where both have a value.

    One aggregate for all pairs. A constant column, or no common row, gives null.
    """
    require_frame(df)
    wanted = numeric_columns(df, columns)
    pairs = list(combinations(wanted, 2))
    if not pairs:
        return _session(df).createDataFrame([], "column_a string, column_b string, pearson_correlation double")

    def correlation(a: str, b: str) -> Column:
        x, y = without_nan(df, a).cast("double"), without_nan(df, b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*(correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"_{i}").alias("pearson_correlation")) for i, (a, b) in enumerate(pairs)))))
    return rows.orderBy(F.abs("pearson_correlation").desc_nulls_last(), "column_a", "column_b")


def detect_outliers_iqr(df: DataFrame, column: str, factor: float = 1.5, accuracy: int = ACCURACY) -> DataFrame:
    """``df`` with the quartiles' fences and whether the value lies beyond them; null is no outlier, NaN is one.

    Without any value the fences are null and nothing is an outlier.
    """
    require_frame(df)
    require_columns(df, column)
    q = F.percentile_approx(without_nan(df, column), [0.25, 0.75], accuracy)
    one = df.agg(q[0].cast("double").alias("__q1"), q[1].cast("double").alias("__q3"))
    reach = F.lit(factor) * (F.col("__q3") - F.col("__q1"))
    rows = df.crossJoin(F.broadcast(one)).withColumns({"iqr_lower_bound": F.col("__q1") - reach, "iqr_upper_bound": F.col("__q3") + reach})
    beyond = (named(column) < F.col("iqr_lower_bound")) | (named(column) > F.col("iqr_upper_bound"))
    return rows.withColumn("is_outlier", F.coalesce(beyond, F.lit(False))).drop("__q1", "__q3")


def compare_dataframes(df1: DataFrame, df2: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Rows of either side only, and both versions of rows whose key is on both sides with other values.

    Null keys are keys like any other. Columns are those of ``df1`` in its order (all must be in
    ``df2``), then diff_type (only_in_df1, only_in_df2, changed) and source (df1, df2). One join.
    """
    require_frame(df1, "df1")
    require_frame(df2, "df2")
    if not key_columns:
        raise ValueError("key_columns must not be empty")
    keys = require_columns(df1, key_columns)
    require_columns(df2, keys)
    columns = df1.columns
    require_columns(df2, columns)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(named(k).alias(f"__{name}_{i}") for i, k in enumerate(keys)), F.struct(*map(named, columns)).alias(f"__{name}"))

    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"__a_{i}").eqNullSafe(F.col(f"__b_{i}"))
    both = side(df1, "a").join(side(df2, "b"), same, "full_outer")
    a, b = F.col("__a"), F.col("__b")
    values = [c for c in columns if c not in keys]
    differ = F.lit(False)
    for c in values:
        differ = differ | ~a.getField(c).eqNullSafe(b.getField(c))

    def out(row: Column, diff: str, source: str) -> Column:
        return F.struct(row.alias("row"), F.lit(diff).alias("diff_type"), F.lit(source).alias("source"))

    rows = F.when(b.isNull(), F.array(out(a, "only_in_df1", "df1"))).when(a.isNull(), F.array(out(b, "only_in_df2", "df2"))).when(differ, F.array(out(a, "changed", "df1"), out(b, "changed", "df2")))
    return both.select(F.inline(rows)).select(*(F.col("row").getField(c).alias(c) for c in columns), "diff_type", "source")


def schema_diff(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """Status of each column of either schema: removed, added, type_changed, unchanged, in this order; reads no data."""
    require_frame(df1, "df1")
    require_frame(df2, "df2")
    one, two = ({f.name: f.dataType.simpleString() for f in d.schema.fields} for d in (df1, df2))
    order = ("removed", "added", "type_changed", "unchanged")

    def status(c: str) -> str:
        return "removed" if c not in two else "added" if c not in one else "unchanged" if one[c] == two[c] else "type_changed"

    rows = sorted(((c, status(c), one.get(c), two.get(c)) for c in one | two), key=lambda r: (order.index(r[1]), r[0]))
    return _session(df1).createDataFrame(rows, "column_name string, status string, type_in_df1 string, type_in_df2 string")


def data_quality_score(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: completeness, uniqueness, validity and their mean, 0 to 100; zeros for an empty table.

    Completeness is the mean share of values present, uniqueness the share of columns whose
    distinct values are over 1 % of the rows, validity the share of numeric columns that vary.
    """
    require_frame(df)
    fields = df.schema.fields
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    ordered = [f.name for f in fields if is_orderable(f.dataType)]
    aggregates = [F.count(named(f.name)).alias(f"_p{i}") for i, f in enumerate(fields)]
    aggregates += [_distinct(named(c), approx).alias(f"_d{i}") for i, c in enumerate(ordered)]
    aggregates += [F.stddev(without_nan(df, c).cast("double")).alias(f"_s{i}") for i, c in enumerate(numbers)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggregates)

    def total(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out

    n = F.col("n")
    complete = total([F.try_divide(F.col(f"_p{i}"), n) for i in range(len(fields))]) / max(1, len(fields)) * 100
    unique = total([F.when(F.try_divide(F.col(f"_d{i}"), n) > 0.01, 1.0).otherwise(0.0) for i in range(len(ordered))]) / max(1, len(ordered)) * 100
    valid = total([F.when(F.col(f"_s{i}") > 0, 1.0).otherwise(0.0) for i in range(len(numbers))]) / len(numbers) * 100 if numbers else F.lit(100.0)
    scores = {"completeness": complete, "uniqueness": unique, "validity": valid}
    rows = one.select(n, *(F.when(n > 0, s).otherwise(0.0).alias(k) for k, s in scores.items()))
    overall = sum((F.col(k) for k in scores), F.lit(0.0)) / 3
    return rows.select(n.alias("total_rows"), F.lit(len(fields)).alias("total_columns"), *(F.round(k, 4).alias(k) for k in scores), F.round(overall, 4).alias("overall"))
