"""Input tables, derived views and versioned Parquet sinks."""
