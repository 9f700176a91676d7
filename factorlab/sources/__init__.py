"""Bar tables: read from Parquet, or built from tables of events and order lines; and written feature tables."""
