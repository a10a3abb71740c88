"""tiza: assessment analytics and data processing on PySpark DataFrames."""
