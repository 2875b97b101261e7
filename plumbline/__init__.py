"""plumbline: feature engineering and regression diagnostics on Spark DataFrames."""

from plumbline.spec import ColumnSpec, SchemaSpec, safe_name
from plumbline.table import FeatureTable

__all__ = ["ColumnSpec", "FeatureTable", "SchemaSpec", "safe_name"]
