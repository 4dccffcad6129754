"""Single operators on small literal tables: edge values, ties, nulls, NaN, odd names, errors, plan shapes."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomframe.operators import calendar, cleansing, display, features, learning, profiling


def rows(df):
    return [tuple(r) for r in df.collect()]


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- cleansing

@pytest.mark.parametrize(
    ("names", "clean"),
    [
        (["First Name"], ["first_name"]),
        (["Sales@2024!", "  hello   world  ", "___"], ["sales_2024", "hello_world", "col"]),
        (["First Name", "first name"], ["first_name", "first_name_1"]),
        (["a b", "a_b", "a_b_1"], ["a_b", "a_b_1", "a_b_1_1"]),
    ],
)
def test_clean_column_names(spark, names, clean):
    assert cleansing.clean_column_names(spark.range(1).select(*(F.lit(i).alias(n) for i, n in enumerate(names)))).columns == clean


def test_drop_null_columns(spark):
    df = make(spark, [(1, None, "a", math.nan), (2, None, None, math.nan)], "id int, none string, half string, nan double")
    assert cleansing.drop_null_columns(df).columns == ["id", "half"]
    assert cleansing.drop_null_columns(df, 0.5).columns == ["id"]
    assert cleansing.drop_null_columns(df.limit(0)).columns == df.columns
    for bad in (0.0, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            cleansing.drop_null_columns(df, bad)
    with pytest.raises(ValueError, match="df must not be None"):
        cleansing.drop_null_columns(None)


def test_drop_constant_columns(spark):
    df = make(spark, [(1, "x", None, [1]), (2, "x", None, [2])], "id int, same string, none string, nested array<int>")
    assert cleansing.drop_constant_columns(df).columns == ["id", "nested"]


def test_fill_nulls_keeps_types(spark):
    df = make(spark, [(None, None, None, None)], "i int, d decimal(10,2), s string, t date")
    filled = cleansing.fill_nulls_by_type(df, 1.5, "none", "2024-01-02")
    assert filled.dtypes == df.dtypes
    assert rows(filled)[0][2:] == ("none", dt.date(2024, 1, 2))
    assert rows(cleansing.fill_nulls_by_type(df))[0][3] is None


def test_deduplicate(spark):
    df = make(spark, [(1, 10), (1, 20), (2, 5), (2, None)], "id long, score long")
    assert sorted(rows(cleansing.deduplicate(df, "id", "-score"))) == [(1, 20), (2, 5)]
    assert sorted(rows(cleansing.deduplicate(df, ["id"], ["score"], "last")), key=str) == [(1, 20), (2, 5)]
    assert cleansing.deduplicate(df.unionAll(df)).count() == 4
    with pytest.raises(ValueError, match="keep must be"):
        cleansing.deduplicate(df, keep="any")
    with pytest.raises(ValueError, match="not found in DataFrame"):
        cleansing.deduplicate(df, ["nope"])


def test_standardize_strings(spark):
    df = make(spark, [("  A  B ", None, 1)], "a string, `b.c` string, n int")
    assert rows(cleansing.standardize_strings(df)) == [("a b", None, 1)]


def test_outliers(spark):
    df = make(spark, [(float(x),) for x in [*range(1, 11), 9999]] + [(None,), (math.nan,)], "val double")
    kept = [r[0] for r in cleansing.remove_outliers(df, "val").collect()]
    assert sorted(x for x in kept if x is not None) == [float(x) for x in range(1, 11)] and None in kept
    assert max(x for (x,) in rows(cleansing.cap_outliers(df, "val")) if x is not None and not math.isnan(x)) < 9999
    flat = make(spark, [(5.0,)] * 50 + [(10000.0,)], "val double")
    assert cleansing.remove_outliers(flat, "val", "zscore").count() == 50
    none = make(spark, [(None,)], "val double")
    assert rows(cleansing.remove_outliers(none, "val")) == rows(cleansing.cap_outliers(none, "val")) == [(None,)]
    assert rows(profiling.detect_outliers_iqr(none, "val")) == [(None, None, None, False)]
    assert sum(r.is_outlier for r in profiling.detect_outliers_iqr(df, "val").collect()) == 2  # 9999 and NaN
    with pytest.raises(ValueError, match="method must be"):
        cleansing.remove_outliers(df, "val", "other")


def test_schema_and_types(spark):
    df = make(spark, [("42", "x")], "age string, name string")
    assert cleansing.validate_schema(df, {"age": "int", "name": "STR", "b": "bool"}) == {"missing_cols": ["b"], "extra_cols": [], "type_mismatches": {"age": {"expected": "int", "actual": "string"}}}
    assert rows(cleansing.enforce_types(df, {"age": "integer", "name": "int", "none": "int"})) == [(42, None)]


def test_rules(spark):
    df = make(spark, [(25, 1.0), (-5, 1.0), (None, 1.0), (150, None)], "age int, salary double")
    for rule in ("col('age').between(0, 120)", "age between 0 and 120", F.col("age").between(0, 120), "(col('age') >= 0) & ~(col('age') > 120)"):
        assert [r.is_valid for r in cleansing.flag_invalid_rows(df, {"age": rule}).collect()] == [True, False, False, False]
    valid, invalid = cleansing.split_valid_invalid(df, {"age": "col('age') > 0", "salary": "salary > 0"})
    assert (valid.count(), invalid.count()) == (1, 3)
    for bad in ("col('age').__class__", "__import__('os').system('true') or col('age')", "col('age').foo()", "col("):
        with pytest.raises(ValueError, match="Could not evaluate rule"):
            cleansing.flag_invalid_rows(df, {"bad": bad})
    with pytest.raises(ValueError, match="rules must not be empty"):
        cleansing.flag_invalid_rows(df, {})


def test_normalize_values(spark):
    df = make(spark, [("Y",), ("maybe",), (None,)], "flag string")
    assert rows(cleansing.normalize_values(df, "flag", {"Y": "yes"})) == [("yes",), ("maybe",), (None,)]
    assert rows(cleansing.normalize_values(make(spark, [(1,), (2,)], "n int"), "n", {"1": "5"})) == [(5,), (2,)]
    with pytest.raises(ValueError, match="mapping must not be empty"):
        cleansing.normalize_values(df, "flag", {})


# --- profiling

def test_profile_complex_types(spark):
    df = make(spark, [(1, ["a"], {"k": "v"}, (1,)), (2, None, None, None)], "id int, tags array<string>, props map<string,string>, info struct<x:int>")
    report = {r.column_name: r for r in profiling.profile_table(df).collect()}
    assert (report["id"].min, report["id"].max, report["id"].distinct_count, report["id"].sample_values) == ("1", "2", 2, "1, 2")
    assert report["tags"].null_pct == 50.0 and report["tags"].min is None and report["props"].distinct_count is None
    assert profiling.profile_table(df.limit(0)).count() == 0
    assert profiling.profile_table(spark.range(200), 50).count() == 1


def test_reports(spark):
    df = make(spark, [("a", None), ("b", None), ("c", 1)], "name string, age long")
    assert rows(profiling.null_report(df)) == [("age", 2, 66.6667), ("name", 0, 0.0)]
    assert rows(profiling.null_report(df.limit(0))) == []
    assert rows(profiling.cardinality_report(df)) == [("name", 3, 1.0), ("age", 1, 0.333333)]
    counts = make(spark, [("A",)] * 3 + [("B",), (None,)], "cat string")
    assert rows(profiling.value_counts(counts, "cat")) == [("A", 3, 60.0), ("B", 1, 20.0), (None, 1, 20.0)]
    assert profiling.numeric_summary(make(spark, [("a",)], "s string")).count() == 0


def test_report_is_one_scan_and_lazy(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") * 2.0).write.parquet(str(tmp_path / "t"))
    for report in (profiling.null_report, profiling.numeric_summary, profiling.correlation_matrix, profiling.data_quality_score):
        plan = report(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Python" not in plan


def test_correlation(spark):
    df = make(spark, [(1, 2, 7.0, None), (2, 4, 7.0, None), (3, 6, 7.0, None)], "x long, y long, same double, none double")
    found = {(a, b): c for a, b, c in rows(profiling.correlation_matrix(df))}
    assert found["x", "y"] == pytest.approx(1.0) and found["x", "same"] is None and found["x", "none"] is None
    gappy = make(spark, [(1.0, 1.0), (2.0, None), (3.0, 3.0), (4.0, 4.0)], "a double, b double")
    assert rows(profiling.correlation_matrix(gappy))[0][2] == pytest.approx(1.0)


def test_compare_dataframes(spark):
    one = make(spark, [("a", 1, 10), ("b", 2, 20), ("c", None, 30)], "name string, id long, value long")
    two = make(spark, [(2, "b", 21), (3, "d", 40), (None, "c", 30)], "id long, name string, value long")
    found = profiling.compare_dataframes(one, two, ["id"])
    assert found.columns == ["name", "id", "value", "diff_type", "source"]
    assert sorted(rows(found)) == [("a", 1, 10, "only_in_df1", "df1"), ("b", 2, 20, "changed", "df1"), ("b", 2, 21, "changed", "df2"), ("d", 3, 40, "only_in_df2", "df2")]
    with pytest.raises(ValueError, match="key_columns"):
        profiling.compare_dataframes(one, two, [])


def test_quality_score(spark):
    assert rows(profiling.data_quality_score(make(spark, [], "a int, b string"))) == [(0, 2, 0.0, 0.0, 0.0, 0.0)]
    score = profiling.data_quality_score(make(spark, [(1, 5), (2, 5)], "id long, same long")).first()
    assert (score.completeness, score.validity) == (100.0, 50.0)


# --- calendar

def test_parse_dates(spark):
    df = make(spark, [("2024-03-15",), ("03/15/2024",), ("20240315",), ("nope",)], "d string")
    assert [r[0] for r in rows(calendar.parse_dates(df, "d"))] == [dt.date(2024, 3, 15)] * 3 + [None]


@pytest.mark.parametrize(
    ("day", "n", "mode", "due"),
    [("2024-03-15", 1, "roll", "2024-03-18"), ("2024-03-11", 5, "roll", "2024-03-18"), ("2024-03-11", 10, "roll", "2024-03-25"), ("2024-03-18", -1, "roll", "2024-03-15"),
     ("2024-03-16", 1, "roll", "2024-03-18"), ("2024-03-16", 0, "roll", "2024-03-16"), ("2024-03-16", -1, "roll", "2024-03-15"), ("2024-03-16", 1, "reference", "2024-03-19"),
     ("2024-03-17", 1, "reference", "2024-03-20")],
)
def test_business_days(spark, day, n, mode, due):
    df = make(spark, [(dt.date.fromisoformat(day),)], "d date")
    assert str(calendar.add_business_days(df, "d", n, "due", mode).first().due) == due


def test_spine_and_gaps(spark):
    assert calendar.generate_date_spine(spark, "2024-01-01", "2024-01-07").count() == 7
    assert calendar.generate_date_spine(spark, "2024-01-01 00:00:00", "2024-01-01 06:00:00", "hour").count() == 7
    with pytest.raises(ValueError, match="Unsupported interval"):
        calendar.generate_date_spine(spark, "2024-01-01", "2024-01-02", "minute")
    df = make(spark, [(dt.date(2024, 1, 1), "A", 5, "x"), (dt.date(2024, 1, 3), "B", None, "y")], "sale_date date, store string, revenue long, note string")
    filled = calendar.fill_date_gaps(df, "sale_date", ["store"])
    assert filled.columns == ["date", "store", "revenue", "note"] and filled.count() == 6
    assert filled.agg(F.sum("revenue")).first()[0] == 5 and filled.where("revenue = 0").count() == 5
    assert calendar.fill_date_gaps(df, "sale_date", keep_name=True).columns[0] == "sale_date"
    assert calendar.fill_date_gaps(df.limit(0), "sale_date").count() == 0


def test_time_parts_and_periods(spark):
    df = make(spark, [(dt.datetime(2024, 3, 15, h, 30),) for h in (5, 6, 12, 17, 21)] + [(None,)], "t timestamp")
    assert [r[1] for r in rows(calendar.bucket_time_of_day(df, "t"))] == ["night", "morning", "afternoon", "evening", "night", None]
    for call, match in ((calendar.add_date_parts, "Unsupported date part"), (calendar.add_time_parts, "Unsupported time part")):
        with pytest.raises(ValueError, match=match):
            call(df, "t", ["eon"])
    with pytest.raises(ValueError, match="fiscal_start_month"):
        calendar.add_fiscal_year(df, "t", 13)
    with pytest.raises(ValueError, match="Unsupported units"):
        calendar.add_time_since(df, "t", units="eons")


def test_floor_and_truncate_differ_before_the_start(spark):
    df = make(spark, [(dt.date(2024, 3, 15), dt.date(2024, 1, 1))], "a date, b date")
    assert calendar.date_diff_columns(df, "a", "b", "months").first()["a_to_b_diff_months"] == -2
    assert calendar.add_time_since(df, "a", "2024-01-01", "months").first()["a_since_months"] == -3


# --- display

def test_show_and_peek_return_the_frame(spark, capsys):
    df = spark.range(3)
    assert display.show_df(df) is df and display.peek(df, 2) is df
    assert "3 rows" in capsys.readouterr().out


def test_histogram(spark):
    df = make(spark, [(float(i),) for i in range(100)] + [(None,), (math.nan,)], "v double")
    bins = display.histogram_data(df, "v", 7).collect()
    assert len(bins) == 7 and sum(b["count"] for b in bins) == 100
    assert rows(display.histogram_data(make(spark, [(5.0,)] * 3, "v double"), "v")) == [(0, 5.0, 5.0, 3)]
    assert display.histogram_data(make(spark, [(None,)], "v double"), "v").count() == 0


def test_percent_crosstab_top(spark):
    df = make(spark, [(0.123,), (None,), (1.0,)], "rate double")
    assert [r[0] for r in rows(display.format_pct_columns(df, ["rate"]))] == ["12.3%", None, "100.0%"]
    assert [r[0] for r in rows(display.format_pct_columns(make(spark, [(1,)], "rate int"), ["rate"]))] == ["100.0%"]
    cross = display.crosstab_pct(make(spark, [("a", "x"), ("b", "y"), ("a", "y"), (None, "x")], "r string, c string"), "r", "c")
    assert cross.columns == ["r_c", "x", "y"] and rows(cross) == [("a", 25.0, 25.0), ("b", 0.0, 25.0), ("null", 25.0, 0.0)]
    top = display.top_n_by_group(make(spark, [("A", 1), ("A", None), ("A", 3)], "g string, s int"), "g", "s", 2)
    assert [r.s for r in top.collect()] == [3, 1]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="agg_func"):
        display.pivot_summary(df, "rate", "rate", "median")


# --- features

def test_encode_and_bins(spark):
    df = make(spark, [("cat",), ("dog",), ("cat",), (None,)], "animal string")
    out, stages = features.encode_categoricals(df, ["animal"], "onehot", "skip")
    assert len(stages) == 2 and out.count() == 3
    assert [r.animal_indexed for r in features.encode_categoricals(df, ["animal"])[0].collect()] == [0.0, 1.0, 0.0, 2.0]
    with pytest.raises(ValueError, match="custom_splits must be provided"):
        features.create_bins(make(spark, [(1.0,)], "v double"), "v", "custom")


def test_impute(spark):
    df = make(spark, [(1, "a", 10), (2, "a", 25), (None, "b", None), (5, "b", 60)], "val long, g string, w long")
    out, values = features.impute_columns(df, "mean", ["w"])
    assert values["w"] == pytest.approx(95 / 3) and dict(out.dtypes)["w"] == "double" and [r.w for r in out.collect()][2] == pytest.approx(95 / 3)
    assert [r.val for r in features.impute_columns(df, "median", ["val"], "g")[0].orderBy("g", "val").collect()] == [1, 2, 5, 5]
    assert [r.val for r in features.impute_columns(df, "mode", ["val"], "g")[0].orderBy("g", "val").collect()] == [1, 2, 5, 5]
    with pytest.raises(ValueError, match="strategy must be"):
        features.impute_columns(df, "guess")


def test_prepare_features(spark):
    df = make(spark, [(30.0, None, "x", 1), (None, 5.0, "y", 0), (50.0, 7.0, None, 1)], "age double, salary double, dept string, label long")
    out, parts = features.prepare_features(df, ["age", "salary"], ["dept"], "label")
    assert out.count() == 3 and len(out.first().scaled_features) == len(parts["feature_cols"]) == 6


# --- learning

def test_split_data(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    for stratify in (None, "g"):
        parts = learning.split_data(df, [0.6, 0.2, 0.2], stratify_col=stratify)
        sizes = [p.count() for p in parts]
        assert sum(sizes) == 2000 and abs(sizes[0] - 1200) < 60
        assert parts[0].unionAll(parts[1]).unionAll(parts[2]).distinct().count() == 2000
        assert sorted(rows(parts[1])) == sorted(rows(learning.split_data(df, [0.6, 0.2, 0.2], stratify_col=stratify)[1]))
    with pytest.raises(ValueError, match="ratios must contain 2"):
        learning.split_data(df, [1.0])
    with pytest.raises(ValueError, match="sum to 1.0"):
        learning.split_data(df, [0.5, 0.6])


def test_reports_of_models(spark):
    df = make(spark, [(float(a), float(b)) for a, b in [(0, 0)] * 4 + [(1, 1)] * 4 + [(0, 1), (1, 0)]], "label double, prediction double")
    assert learning.classification_report(df)["metrics"]["accuracy"] == pytest.approx(0.8)
    report = learning.regression_report(make(spark, [(1.0, 2.0), (0.0, 0.0)], "label double, prediction double"))
    assert report["rmse"] == pytest.approx(math.sqrt(report["mse"])) and report["mape"] == 1.0
    sweep, best = learning.find_best_threshold(make(spark, [(1.0, 0.9), (0.0, 0.4), (1.0, 0.6)], "label double, p double"), "label", "p")
    assert best == 0.5 and sweep.count() == 9


def test_imbalance(spark):
    df = spark.range(2000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    over = dict(rows(learning.handle_class_imbalance(df).groupBy("label").count()))
    assert over == {0: 1600, 1: 1600}
    under = dict(rows(learning.handle_class_imbalance(df, strategy="undersample").groupBy("label").count()))
    assert under[1] == 400 and abs(under[0] - 400) < 60
    with pytest.raises(ValueError, match="binary labels"):
        learning.handle_class_imbalance(spark.range(9).withColumn("label", F.col("id") % 3))
