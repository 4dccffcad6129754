"""Every operator in one namespace."""

from .operators.calendar import (
    add_age, add_business_days, add_date_parts, add_fiscal_year, add_time_parts, add_time_since, bucket_time_of_day, date_diff_columns,
    fill_date_gaps, generate_date_spine, is_business_day, parse_dates,
)
from .operators.cleansing import (
    cap_outliers, clean_column_names, deduplicate, drop_constant_columns, drop_null_columns, enforce_types, fill_nulls_by_type,
    flag_invalid_rows, normalize_values, remove_outliers, split_valid_invalid, standardize_strings, validate_schema,
)
from .operators.display import (
    add_row_numbers, compare_side_by_side, crosstab_pct, format_number_columns, format_pct_columns, histogram_data, peek, pivot_summary,
    show_df, summary_table, top_n_by_group,
)
from .operators.features import (
    add_date_features, add_interaction_features, add_lag_features, add_missing_indicators, add_ratio_features, add_rolling_features,
    assemble_features, create_bins, encode_categoricals, impute_columns, prepare_features, scale_features,
)
from .operators.learning import (
    batch_predict, classification_report, compare_models, cross_validate, feature_importance, find_best_threshold, handle_class_imbalance,
    regression_report, split_data, train_and_evaluate,
)
from .operators.profiling import (
    cardinality_report, compare_dataframes, correlation_matrix, data_quality_score, detect_outliers_iqr, null_report, numeric_summary,
    profile_table, schema_diff, value_counts,
)
from .sources.files import read_csv_with_schema, read_files_from_volume, write_to_volume
from .sources.runs import (
    cleanup_runs, compare_model_versions, get_best_run, get_run_comparison, load_model, log_data_snapshot, log_grid_search, log_run,
    log_run_to_mlflow, log_spark_model, promote_model, setup_experiment,
)
from .sources.tables import (
    backup_table, create_table_if_not_exists, get_table_info, list_tables, merge_into, read_table_safe, scd_type2, table_exists, write_table,
)

__all__ = sorted(k for k, v in list(globals().items()) if callable(v) and not k.startswith("_"))
