"""Where tables live: parquet files as they are, and versioned change-log tables."""
