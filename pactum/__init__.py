"""A PySpark engine for declarative data contracts over Parquet tables."""
