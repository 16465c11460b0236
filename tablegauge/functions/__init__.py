from tablegauge.functions.columns import (
    DATETIME, CATEGORICAL, NUMERIC, BOOLEAN, UNKNOWN,
    eda_kind, eda_kinds, is_numeric_type, numeric_columns, quote,
)

__all__ = [
    "DATETIME", "CATEGORICAL", "NUMERIC", "BOOLEAN", "UNKNOWN",
    "eda_kind", "eda_kinds", "is_numeric_type", "numeric_columns", "quote",
]
