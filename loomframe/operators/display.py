"""Showing and summarising tables for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.core import is_orderable, named, numeric_columns, require_choice, require_columns, require_frame, unpivoted, without_nan
from .profiling import sample_values

AGGREGATES = {"sum": F.sum, "avg": F.avg, "mean": F.mean, "count": F.count, "min": F.min, "max": F.max}
SUMMARY_SAMPLES = 3


def show_df(df: DataFrame, n: int = 20, truncate: bool | int = False, vertical: bool = False) -> DataFrame:
    """Prints ``n`` rows and returns ``df``."""
    require_frame(df)
    df.show(n, truncate=truncate, vertical=vertical)
    return df


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """Prints the shape, the schema and ``n`` rows, and returns ``df``."""
    require_frame(df)
    print(f"{df.count()} rows x {len(df.columns)} columns")
    df.printSchema()
    df.show(n, truncate=False)
    return df


def summary_table(df: DataFrame) -> DataFrame:
    """A row for each column: type, nullability, nulls, approximate distinct count and up to 3 values."""
    require_frame(df)
    per = {}
    for f in df.schema.fields:
        c, ordered = named(f.name), is_orderable(f.dataType)
        per[f.name] = {
            "data_type": F.first(F.lit(str(f.dataType))),
            "nullable": F.first(F.lit(f.nullable)),
            "null_count": F.count_if(c.isNull()),
            "distinct_count": F.approx_count_distinct(c if ordered else F.to_json(F.struct(c))),
            "sample_values": sample_values(c, ordered, SUMMARY_SAMPLES) if ordered else F.max(F.lit(None).cast("string")),
        }
    rows = unpivoted(df, per, {"n": F.count(F.lit(1))})
    pct = F.when(F.col("n") > 0, F.round(F.col("null_count") / F.col("n") * 100, 2)).otherwise(0.0)
    return rows.select(F.col("column_name").alias("column"), "data_type", "nullable", "null_count", pct.alias("null_pct"), "distinct_count", "sample_values")


def compare_side_by_side(df1: DataFrame, df2: DataFrame, name1: str = "df1", name2: str = "df2") -> DataFrame:
    """Prints row counts and what differs; returns a row for each column of either schema, by name."""
    require_frame(df1, "df1")
    require_frame(df2, "df2")
    one, two = ({f.name: str(f.dataType) for f in d.schema.fields} for d in (df1, df2))
    rows = [(c, c in one, c in two, one.get(c, ""), two.get(c, ""), one.get(c) == two.get(c)) for c in sorted(one | two)]
    print(f"{name1}: {df1.count()} rows x {len(one)} columns; {name2}: {df2.count()} rows x {len(two)} columns")
    for title, names in ((f"only in {name1}", sorted(set(one) - set(two))), (f"only in {name2}", sorted(set(two) - set(one))), ("of another type", [r[0] for r in rows if r[1] and r[2] and not r[5]])):
        if names:
            print(f"{title}: {', '.join(names)}")
    return df1.sparkSession.createDataFrame(rows, f"column string, `in_{name1}` boolean, `in_{name2}` boolean, `type_{name1}` string, `type_{name2}` string, types_match boolean")


def format_number_columns(df: DataFrame, columns: Sequence[str] | None = None, decimals: int = 2) -> DataFrame:
    """Numeric columns rounded half up; all of them by default."""
    require_frame(df)
    wanted = numeric_columns(df, columns)
    return df.withColumns({c: F.round(named(c), decimals) for c in wanted}) if wanted else df


def format_pct_columns(df: DataFrame, columns: Sequence[str], decimals: int = 1) -> DataFrame:
    """Fractions as text with a percent sign; null stays null."""
    require_frame(df)
    wanted = require_columns(df, columns)
    return df.withColumns({c: F.when(named(c).isNotNull(), F.format_string(f"%.{decimals}f%%", F.round(named(c).cast("double") * 100, decimals))) for c in wanted}) if wanted else df


def add_row_numbers(df: DataFrame, col_name: str = "row_num") -> DataFrame:
    """A unique, not gapless, number first in each row, without a shuffle."""
    require_frame(df)
    return df.select(F.monotonically_increasing_id().alias(col_name), *map(named, df.columns))


def pivot_summary(df: DataFrame, group_col: str, value_col: str, agg_func: str = "sum", pivot_col: str | None = None, pivot_values: Sequence | None = None) -> DataFrame:
    """``{agg_func}_{value_col}`` for each group, or one column for each value of ``pivot_col``; ordered by group.

    Without ``pivot_values`` Spark runs a job to find them.
    """
    require_frame(df)
    require_choice(agg_func, list(AGGREGATES), "agg_func")
    require_columns(df, [group_col, value_col, *([pivot_col] if pivot_col else [])])
    value = AGGREGATES[agg_func](named(value_col)).alias(f"{agg_func}_{value_col}")
    groups = df.groupBy(named(group_col))
    return (groups.pivot(pivot_col, list(pivot_values) if pivot_values is not None else None) if pivot_col else groups).agg(value).orderBy(named(group_col))


def histogram_data(df: DataFrame, column: str, n_bins: int = 20) -> DataFrame:
    """Equal-width bins with their counts; empty bins count 0, null and NaN are left out, the maximum is in the last bin.

    A constant column is one bin; without any value there is none. Lazy: the range is part of the plan.
    """
    require_frame(df)
    require_columns(df, column)
    if n_bins < 1:
        raise ValueError("n_bins must be 1 or more")
    x = without_nan(df, column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo is not null")
    ends = ends.withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(n_bins)).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("width"))), F.col("bins") - 1), F.lit(0)).cast("int")
    counts = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(ends)).groupBy(place.alias("bin_index")).agg(F.count(F.lit(1)).alias("count"))
    bins = ends.select("lo", "hi", "width", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin_index"))
    start = F.col("lo") + F.col("bin_index") * F.col("width")
    end = F.when(F.col("bin_index") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin_index") + 1) * F.col("width"))
    rows = bins.join(counts, "bin_index", "left")
    return rows.select("bin_index", start.alias("bin_start"), end.alias("bin_end"), F.coalesce("count", F.lit(0)).cast("long").alias("count")).orderBy("bin_index")


def top_n_by_group(df: DataFrame, group_col: str, order_col: str, n: int = 5, ascending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; nulls come last; ``ties`` order equal values."""
    require_frame(df)
    require_columns(df, [group_col, order_col, *ties])
    order = named(order_col).asc_nulls_last() if ascending else named(order_col).desc_nulls_last()
    ranked = Window.partitionBy(named(group_col)).orderBy(order, *map(named, ties))
    return df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n).orderBy(named(group_col), "rank")


def crosstab_pct(df: DataFrame, col1: str, col2: str) -> DataFrame:
    """Percentage of all rows for each pair of values; rows by ``col1``, one column for each value of ``col2``.

    Null is labelled "null". An empty table gives an empty table.
    """
    require_frame(df)
    require_columns(df, [col1, col2])
    label = f"{col1}_{col2}"
    text = {k: F.coalesce(named(c).cast("string"), F.lit("null")) for k, c in ((label, col1), ("__c", col2))}
    cells = df.groupBy(*(c.alias(k) for k, c in text.items())).agg(F.count(F.lit(1)).alias("__n"))
    wide = cells.groupBy(named(label)).pivot("__c").agg(F.sum("__n"))
    total = F.broadcast(cells.agg(F.sum("__n").alias("__total")))
    values = [c for c in wide.columns if c != label]
    shares = [F.round(F.coalesce(named(c), F.lit(0)) / F.col("__total") * 100, 2).alias(c) for c in values]
    return wide.crossJoin(total).select(named(label), *shares).orderBy(named(label))
