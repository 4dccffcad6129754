"""Catalog tables: reading, writing, upsert, slowly changing dimensions, copies.

``merged`` and ``scd2`` are pure plans over DataFrames. The functions that change a table write its new
version to a staging table first and then overwrite the rows of the table from there, so that its provider,
place, comment, properties and partitioning stay; where the table's format has a MERGE of its own, that is used.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.core import column_names, named, require_choice, require_columns, require_frame

MODES = ("overwrite", "append", "ignore", "error", "errorifexists")


def quoted(table_name: str) -> str:
    return ".".join(p if p.startswith("`") else "`" + p.replace("`", "``") + "`" for p in table_name.split("."))


def table_exists(spark: SparkSession, table_name: str) -> bool:
    """Whether the catalog has a table or view of this one- to three-part name."""
    return spark.catalog.tableExists(table_name)


def read_table_safe(spark: SparkSession, table_name: str, columns: Sequence[str] | None = None, filter_expr: str | None = None, limit: int | None = None) -> DataFrame | None:
    """The table, None if there is none; filtered, cut to columns and limited, in this order."""
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("limit must be an integer of 0 or more")
    if not table_exists(spark, table_name):
        return None
    df = spark.table(table_name)
    if columns:
        require_columns(df, columns)
    if filter_expr:
        df = df.where(filter_expr)
    if columns:
        df = df.select(*map(named, columns))
    return df if limit is None else df.limit(limit)


def write_table(df: DataFrame, table_name: str, mode: str = "overwrite", partition_by: str | Sequence[str] | None = None, optimize_after: bool = True) -> None:
    """Saves a table; ``optimize_after`` has Spark balance its files by the partition columns before they are written."""
    require_frame(df)
    require_choice(mode, MODES, "mode")
    keys = require_columns(df, column_names(partition_by))
    if optimize_after:
        df = df.hint("rebalance", *keys) if keys else df.hint("rebalance")
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).saveAsTable(table_name)


def create_table_if_not_exists(spark: SparkSession, df: DataFrame, table_name: str, partition_by: str | Sequence[str] | None = None, comment: str | None = None) -> bool:
    """Creates the table with the rows of ``df`` if there is none; whether it did."""
    if table_exists(spark, table_name):
        return False
    write_table(df, table_name, "error", partition_by, optimize_after=False)
    if comment:
        text = comment.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {quoted(table_name)} IS '{text}'")
    return True


def backup_table(spark: SparkSession, source_table: str, backup_suffix: str | None = None) -> str:
    """A full copy under ``{source}_bkp_{UTC time}`` or the given suffix, partitioned alike; its name."""
    name = f"{source_table}{backup_suffix if backup_suffix is not None else datetime.now(UTC).strftime('_bkp_%Y%m%d_%H%M%S')}"
    write_table(spark.table(source_table), name, "error", _partitions(spark, source_table), optimize_after=False)
    return name


def list_tables(spark: SparkSession, database: str | None = None, pattern: str | None = None) -> list[dict]:
    """Tables and views of a database, those whose name fits the shell pattern."""
    found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
    return [
        {"catalog": t.catalog or "", "database": (t.namespace or [""])[0] or "", "name": t.name, "table_type": t.tableType or "", "is_temporary": str(t.isTemporary)}
        for t in found
        if pattern is None or fnmatch.fnmatch(t.name, pattern)
    ]


def _partitions(spark: SparkSession, table_name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table_name) if c.isPartition]


def get_table_info(spark: SparkSession, table_name: str) -> dict:
    """row_count, column_count, columns, size_bytes, partitioned_by and last_modified (None where unknown)."""
    df = spark.table(table_name)
    info = {"row_count": None, "column_count": len(df.columns), "columns": df.columns, "size_bytes": None, "partitioned_by": _partitions(spark, table_name), "last_modified": None}
    detail = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {quoted(table_name)}").collect()}
    if "Type" in detail and detail["Type"] != "VIEW":
        spark.sql(f"ANALYZE TABLE {quoted(table_name)} COMPUTE STATISTICS")
        detail = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {quoted(table_name)}").collect()}
        for part in detail.get("Statistics", "").split(","):
            number, _, unit = part.strip().partition(" ")
            if unit.startswith("row"):
                info["row_count"] = int(number)
            elif unit.startswith("byte"):
                info["size_bytes"] = int(number)
        files = df.select(F.max(F.col("_metadata.file_modification_time")).alias("t")).first()
        info["last_modified"] = files["t"]
    else:
        info["row_count"] = df.count()
    return info


def _same_keys(a: str, b: str, keys: Sequence[str], null_safe: bool = False) -> Column:
    out = F.lit(True)
    for k in keys:
        x, y = F.col(f"{a}.`{k}`"), F.col(f"{b}.`{k}`")
        out = out & (x.eqNullSafe(y) if null_safe else x == y)
    return out


def merged(target: DataFrame, source: DataFrame, merge_keys: str | Sequence[str], update_columns: Sequence[str] | None = None, insert_all: bool = True) -> DataFrame:
    """``target`` with matched rows updated (all shared non-key columns by default) and unmatched source rows added.

    Null keys match nothing. Several source rows for one target row fail the query. Columns that
    the source lacks are null in added rows. One full outer join; nothing runs until it is used.
    """
    keys = require_columns(source, merge_keys)
    require_columns(target, keys)
    columns = [c for c in source.columns if c not in keys and c in target.columns] if update_columns is None else require_columns(source, update_columns)
    counted = source.groupBy(*map(named, keys)).agg(F.count(F.lit(1)).alias("__n"), *(F.first(named(c)).alias(c) for c in source.columns if c not in keys))
    complete = F.lit(True)
    for k in keys:
        complete = complete & named(k).isNotNull()
    s = counted.where(complete).withColumn("__s", F.lit(True))
    t = target.withColumn("__t", F.lit(True))
    both = t.alias("t").join(s.alias("s"), _same_keys("t", "s", keys), "full_outer" if insert_all else "left_outer")
    hit, is_target = F.col("s.__s").isNotNull(), F.col("t.__t").isNotNull()
    # a key that is twice in the source is an error only if it would change a target row twice
    checked = F.when(hit & is_target & (F.col("s.__n") > 1), F.raise_error(F.lit("several source rows match one target row")).cast("boolean")).otherwise(F.lit(True))

    def value(c: str) -> Column:
        old, new = F.col(f"t.`{c}`"), F.col(f"s.`{c}`") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        changed = new if c in columns else old
        return F.when(is_target & hit, changed).when(is_target, old).otherwise(new).cast(target.schema[c].dataType).alias(c)

    out = both.where(checked & (is_target | (F.col("s.__n") == 1))).select(*map(value, target.columns))
    if not insert_all:
        return out
    # rows that the grouping can't carry one by one: null keys, and new keys that repeat
    twice = counted.where(complete & (F.col("__n") > 1)).select(*map(named, keys))
    loose = source.where(~complete)
    repeated = source.join(twice, keys, "left_semi").join(target.select(*map(named, keys)), keys, "left_anti")
    extra = loose.unionByName(repeated.select(*map(named, source.columns)))
    return out.unionByName(extra.select(*((named(c) if c in source.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns)))


def provider(spark: SparkSession, table_name: str) -> str:
    """The format of a table in lower case, empty where the catalog doesn't say."""
    detail = spark.sql(f"DESCRIBE EXTENDED {quoted(table_name)}").where("col_name = 'Provider'").first()
    return detail["data_type"].lower() if detail else ""


def merge_statement(table_name: str, source_view: str, columns: Sequence[str], source_columns: Sequence[str], keys: Sequence[str], update_columns: Sequence[str], insert_all: bool) -> str:
    """``merged`` as a MERGE statement, for formats that have it."""
    q = lambda c: "`" + c.replace("`", "``") + "`"
    out = [f"MERGE INTO {quoted(table_name)} AS t USING {quoted(source_view)} AS s ON " + " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)]
    if update_columns:
        out.append("WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{q(c)} = s.{q(c)}" for c in update_columns))
    if insert_all:
        known = [c for c in columns if c in source_columns]
        out.append(f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, known))}) VALUES ({', '.join('s.' + q(c) for c in known)})")
    return " ".join(out)


def _replace_rows(spark: SparkSession, df: DataFrame, table_name: str) -> None:
    """Replaces the rows of a table by a plan that may read it.

    Provider, location, comment, properties and partitioning stay. The new rows are complete in a
    staging table before the table is touched; if the overwrite itself fails, the staging table is
    left and named in the error. On formats without transactions a reader may meet the overwrite.
    """
    staging = f"{table_name}__staging_{uuid.uuid4().hex[:8]}"
    write_table(df, staging, "error", optimize_after=False)
    rows = spark.table(staging).select(*map(named, spark.table(table_name).columns))
    try:
        rows.write.option("partitionOverwriteMode", "static").insertInto(table_name, overwrite=True)
    except Exception as e:
        raise RuntimeError(f"{table_name} could not be overwritten; its new rows are in {staging}") from e
    spark.sql(f"DROP TABLE {quoted(staging)}")
    spark.catalog.refreshTable(table_name)


def merge_into(spark: SparkSession, target_table: str, source_df: DataFrame, merge_keys: str | Sequence[str], update_columns: Sequence[str] | None = None, insert_all: bool = True) -> None:
    """``merged`` written back to the table, by the MERGE of its format (Delta, Iceberg, Hudi) or by overwriting its rows."""
    keys = column_names(merge_keys)
    if not keys:
        raise ValueError("merge_keys must not be empty")
    target = spark.table(target_table)
    if provider(spark, target_table) in ("delta", "iceberg", "hudi"):
        require_columns(source_df, keys)
        require_columns(target, keys)
        changed = [c for c in source_df.columns if c not in keys and c in target.columns] if update_columns is None else require_columns(source_df, update_columns)
        view = f"loomframe_source_{uuid.uuid4().hex[:8]}"
        source_df.createOrReplaceTempView(view)
        try:
            spark.sql(merge_statement(target_table, view, target.columns, source_df.columns, keys, changed, insert_all))
        finally:
            spark.catalog.dropTempView(view)
        return
    _replace_rows(spark, merged(target, source_df, keys, update_columns, insert_all), target_table)


def scd2(
    target: DataFrame,
    source: DataFrame,
    key_columns: str | Sequence[str],
    tracked_columns: Sequence[str],
    as_of: str | Column | None = None,
    effective_date_col: str = "effective_date",
    end_date_col: str = "end_date",
    current_flag_col: str = "is_current",
) -> DataFrame:
    """The next version of a type-2 dimension.

    Current rows whose tracked columns differ from the source's are closed as of ``as_of`` (today in
    UTC), a new current row is opened for them and for keys without a current row; all else stays.
    Null keys match nothing and open rows. Equal source rows count once; several different ones for one key
    fail the query. The target and the source are read twice.
    """
    keys = require_columns(source, key_columns)
    require_columns(source, tracked_columns)
    require_columns(target, [*keys, *tracked_columns, effective_date_col, end_date_col, current_flag_col])
    day = F.lit(as_of) if isinstance(as_of, str) else as_of if as_of is not None else F.to_date(F.lit(datetime.now(UTC).date().isoformat()))
    kinds = {f.name: f.dataType for f in target.schema.fields}
    current = target.where(named(current_flag_col))
    complete = F.lit(True)
    for k in keys:
        complete = complete & named(k).isNotNull()
    source = source.distinct().withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*map(named, keys))))
    ambiguous = F.raise_error(F.lit("several source rows for one key")).cast("boolean")
    source = source.where(F.when(complete & (F.col("__n") > 1), ambiguous).otherwise(F.lit(True)))
    s = source.where(complete).select(*map(named, [*keys, *tracked_columns])).withColumn("__hit", F.lit(True))
    differ = F.lit(False)
    for c in tracked_columns:
        differ = differ | ~F.col(f"t.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    rows = target.alias("t").join(s.alias("s"), _same_keys("t", "s", keys) & F.col(f"t.`{current_flag_col}`"), "left")
    closed = F.col("s.__hit").isNotNull() & differ
    changes = {end_date_col: F.when(closed, day.cast(kinds[end_date_col])).otherwise(F.col(f"t.`{end_date_col}`")), current_flag_col: F.col(f"t.`{current_flag_col}`") & ~closed}
    kept = rows.select(*(changes.get(c, F.col(f"t.`{c}`")).alias(c) for c in target.columns))
    unchanged = current.select(*(named(c) for c in [*keys, *tracked_columns])).alias("t")
    same = _same_keys("s", "t", keys)
    for c in tracked_columns:
        same = same & F.col(f"s.`{c}`").eqNullSafe(F.col(f"t.`{c}`"))
    opened = source.alias("s").join(unchanged, same, "left_anti")
    fixed = {effective_date_col: day, end_date_col: F.lit(None), current_flag_col: F.lit(True)}
    new = opened.select(*((fixed[c] if c in fixed else named(c) if c in source.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns))
    return kept.unionByName(new)


def scd_type2(
    spark: SparkSession,
    target_table: str,
    source_df: DataFrame,
    key_columns: str | Sequence[str],
    tracked_columns: Sequence[str],
    effective_date_col: str = "effective_date",
    end_date_col: str = "end_date",
    current_flag_col: str = "is_current",
) -> None:
    """``scd2`` written back to the table, in one step."""
    if not table_exists(spark, target_table):
        raise ValueError(f"table {target_table} does not exist")
    _replace_rows(spark, scd2(spark.table(target_table), source_df, key_columns, tracked_columns, None, effective_date_col, end_date_col, current_flag_col), target_table)
