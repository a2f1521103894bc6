"""Sources: delimited text with inferred types, Parquet, matrices."""
