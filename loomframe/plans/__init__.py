from .core import column_names, is_date_like, is_numeric, is_orderable, named, numeric_columns, require_columns, require_frame, unpivoted

__all__ = ["column_names", "is_date_like", "is_numeric", "is_orderable", "named", "numeric_columns", "require_columns", "require_frame", "unpivoted"]
