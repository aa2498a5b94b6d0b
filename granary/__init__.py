"""An analytics engine on PySpark: a small SQL dialect lowered to DataFrames."""
