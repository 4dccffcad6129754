"""Files, catalog tables, upserts, dimensions, the run store and streaming runs."""

import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loomframe import streaming
from loomframe.operators import calendar, cleansing, learning
from loomframe.sources import files, runs, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,score\n1,NA,2.5\n2,,-\n3,carol,4\n")
    df = files.read_csv_with_schema(spark, str(tmp_path / "a.csv"), null_values=["NA", "-"])
    assert df.dtypes == [("id", "int"), ("name", "string"), ("score", "double")]
    assert rows(df) == [(1, None, 2.5), (2, None, None), (3, "carol", 4.0)]
    typed = files.read_csv_with_schema(spark, str(tmp_path / "a.csv"), "id long, name string, score double", null_values=["NA", "-"])
    assert rows(typed) == rows(df)
    (tmp_path / "b.csv").write_text("1|x\n")
    assert rows(files.read_csv_with_schema(spark, str(tmp_path / "b.csv"), header=False, delimiter="|")) == [(1, "x")]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_volume_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    files.write_to_volume(df, str(tmp_path / kind), kind)
    files.write_to_volume(df, str(tmp_path / kind), kind, "append")
    assert files.read_files_from_volume(spark, str(tmp_path / kind), kind).count() == 4
    with pytest.raises(ValueError, match="file_format"):
        files.write_to_volume(df, str(tmp_path / "x"), "xml")


def test_catalog(spark):
    df = spark.createDataFrame([(1, "alice", 30), (2, "bob", 25)], "id int, name string, age int")
    assert tables.read_table_safe(spark, "absent_table") is None
    assert tables.create_table_if_not_exists(spark, df, "people_t", "age", "it's a table")
    assert not tables.create_table_if_not_exists(spark, df, "people_t")
    assert rows(tables.read_table_safe(spark, "people_t", ["name"], "id = 2")) == [("bob",)]
    assert tables.read_table_safe(spark, "people_t", limit=1).count() == 1
    for bad in (-1, 1.5):
        with pytest.raises(ValueError, match="limit"):
            tables.read_table_safe(spark, "people_t", limit=bad)
    info = tables.get_table_info(spark, "people_t")
    assert (info["row_count"], info["column_count"], info["partitioned_by"]) == (2, 3, ["age"]) and info["size_bytes"] > 0 and info["last_modified"]
    copy = tables.backup_table(spark, "people_t", "_copy")
    assert copy == "people_t_copy" and spark.table(copy).count() == 2
    assert {t["name"] for t in tables.list_tables(spark, pattern="people_*")} == {"people_t", "people_t_copy"}


def test_merge(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "id int, name string, qty int")
    source = spark.createDataFrame([(2, "B", 20), (3, "c", 30), (None, "m", 9)], "id int, name string, qty int")
    tables.write_table(target, "merge_t")
    tables.merge_into(spark, "merge_t", source, ["id"], ["qty"])
    assert rows(spark.table("merge_t")) == rows(spark.createDataFrame([(1, "a", 1), (2, "b", 20), (3, "c", 30), (None, "n", 0), (None, "m", 9)], target.schema))
    assert tables.merged(target, source, "id", insert_all=False).count() == 3
    assert tables.merged(target, source.where("id = 3").unionAll(source.where("id = 3")), "id").where("id = 3").count() == 2
    with pytest.raises(Exception, match="several source rows"):
        tables.merged(target, source.where("id = 2").unionAll(source.where("id = 2")), "id").collect()


def test_scd2(spark):
    day, old = dt.date(2024, 6, 1), dt.date(2024, 1, 1)
    schema = "id int, tier string, effective_date date, end_date date, is_current boolean"
    target = spark.createDataFrame([(1, "a", old, None, True), (2, "b", old, None, True), (3, "x", old, day, False), (4, None, old, None, True)], schema)
    source = spark.createDataFrame([(1, "A"), (2, "b"), (3, "x"), (4, None), (5, "e")], "id int, tier string")
    out = tables.scd2(target, source, "id", ["tier"], F.lit(day))
    assert rows(out) == rows(spark.createDataFrame([(1, "a", old, day, False), (1, "A", day, None, True), (2, "b", old, None, True), (3, "x", old, day, False), (3, "x", day, None, True), (4, None, old, None, True), (5, "e", day, None, True)], schema))
    tables.write_table(target, "dim_t")
    tables.scd_type2(spark, "dim_t", source, "id", ["tier"])
    assert spark.table("dim_t").where("is_current").count() == 5


def test_run_store(spark, tmp_path):
    runs.set_store(str(tmp_path / "runs"))
    data = spark.createDataFrame([(float(i % 7), float(i % 2)) for i in range(60)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=3)]).fit(data)
    ids = [runs.log_run(model, {"accuracy": a}, {"p": a}, {"note.txt": "hello"}, model_name="m", experiment_path="/e") for a in (0.5, 0.9)]
    assert runs.setup_experiment("/e", {"team": "x"}) == runs.setup_experiment("/e")
    assert runs.get_best_run("/e")["run_id"] == ids[1]
    assert runs.get_best_run("/e", ascending=True)["run_id"] == ids[0]
    with pytest.raises(ValueError, match="No runs found"):
        runs.get_best_run("/e", filter_string="metrics['accuracy'] > 1")
    assert list(runs.get_run_comparison("/e")["metrics.accuracy"]) == [0.9, 0.5]
    assert runs.promote_model("m") == 2 and runs.promote_model("m", 1, "old") == 1
    assert runs.load_model("m").transform(data).count() == 60
    assert learning.batch_predict("models:/m@old", data, "predictions_t").count() == 60 and spark.table("predictions_t").count() == 60
    both = runs.compare_model_versions("m", 1, 2, data.toPandas())
    assert list(both.index) == ["1", "2"] and "accuracy" in both.columns
    assert runs.artifacts(ids[0]).first().content == "hello"
    assert runs.cleanup_runs("/e", keep_top_n=1) == [ids[0]] and runs.cleanup_runs("/e", keep_top_n=1, delete=True) == [ids[0]]
    assert runs.runs().where(F.col("run_id") == ids[0]).count() == 0
    runs.log_spark_model(model, {"f1": 1.0}, ["x"], data, "/s")
    assert "importance_x" in runs.get_best_run("/s", metric="f1")["metrics"]
    parent = runs.log_grid_search(type("Cv", (), {"avgMetrics": [0.1, 0.2]})(), [{"a": 1}, {"a": 2}], "/g")
    assert runs.runs().where(F.col("parent_run_id") == parent).count() == 2
    snapshot = runs.log_data_snapshot(data, sample_size=10)
    assert runs.artifacts(snapshot).count() == 2
    runs.set_store(None)


def test_stateless_operators_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, " A ", dt.date(2024, 3, 15)), (2, None, dt.date(2024, 3, 16))], "id int, name string, day date")
    df.write.parquet(str(tmp_path / "in"))

    def work(d):
        return calendar.is_business_day(cleansing.flag_invalid_rows(cleansing.standardize_strings(d), {"name": "name is not null"}), "day")

    assert {"standardize_strings", "flag_invalid_rows", "is_business_day"} <= set(streaming.STATELESS)
    streaming.streamed(spark, str(tmp_path / "in"), df.schema, work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(work(df))


def test_library_needs_no_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "loomframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_api_has_every_operator():
    from loomframe import api

    assert len(api.__all__) == 92 and all(getattr(api, n).__doc__ for n in api.__all__)


def test_json_lines_of_many_rows(spark, tmp_path):
    files.write_to_volume(spark.range(5).coalesce(1), str(tmp_path / "lines"), "json")
    assert files.read_files_from_volume(spark, str(tmp_path / "lines"), "json").count() == 5


def test_scd2_refuses_ambiguous_keys(spark):
    target = spark.createDataFrame([(1, "a", "2024-01-01", None, True)], "id long, tier string, effective_date string, end_date string, is_current boolean")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "id long, tier string")
    with pytest.raises(Exception, match="several source rows"):
        tables.scd2(target, twice, "id", ["tier"], F.lit("2024-02-01")).collect()
    with pytest.raises(Exception, match="several source rows"):
        tables.scd2(target, spark.createDataFrame([(7, "b"), (7, "c")], "id long, tier string"), "id", ["tier"], F.lit("2024-02-01")).collect()
    equal = spark.createDataFrame([(1, "b"), (1, "b"), (7, "x"), (7, "x"), (None, "n"), (None, "m")], "id long, tier string")
    out = tables.scd2(target, equal, "id", ["tier"], F.lit("2024-02-01"))
    got = sorted((str(r.id), r.tier, r.is_current) for r in out.collect())
    assert got == [("1", "a", False), ("1", "b", True), ("7", "x", True), ("None", "m", True), ("None", "n", True)]


def test_changed_tables_keep_what_they_are(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept_t")
    spark.sql(f"CREATE TABLE kept_t (id BIGINT, v STRING, day STRING) USING orc PARTITIONED BY (day) COMMENT 'of ours' LOCATION '{tmp_path / 'kept'}' TBLPROPERTIES ('owner.team' = 'x')")
    spark.sql("INSERT INTO kept_t VALUES (1, 'a', 'mo'), (2, 'b', 'tu')")
    tables.merge_into(spark, "kept_t", spark.createDataFrame([(2, "B", "we"), (3, "c", "mo")], "id long, v string, day string"), "id")
    assert sorted(map(tuple, spark.table("kept_t").collect())) == [(1, "a", "mo"), (2, "B", "we"), (3, "c", "mo")]
    detail = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED kept_t").collect()}
    assert detail["Provider"].lower() == "orc" and detail["Comment"] == "of ours" and detail["Location"].endswith("kept") and "owner.team" in detail["Table Properties"]
    assert tables.get_table_info(spark, "kept_t")["partitioned_by"] == ["day"]
    assert not [t for t in tables.list_tables(spark, pattern="kept_t__*")]


def test_merge_statement():
    got = tables.merge_statement("db.t", "s", ["id", "a", "b", "only_t"], ["id", "a", "b"], ["id"], ["a", "b"], True)
    assert got == "MERGE INTO `db`.`t` AS t USING `s` AS s ON t.`id` = s.`id` WHEN MATCHED THEN UPDATE SET t.`a` = s.`a`, t.`b` = s.`b` WHEN NOT MATCHED THEN INSERT (`id`, `a`, `b`) VALUES (s.`id`, s.`a`, s.`b`)"


def test_models_without_a_writer_are_refused(spark, tmp_path):
    runs.set_store(str(tmp_path / "store"))
    with pytest.raises(TypeError, match="no Spark ML writer"):
        runs.log_run(object(), {"a": 1.0}, model_name="m")
    assert runs.runs().count() == 0
    runs.set_store(None)
