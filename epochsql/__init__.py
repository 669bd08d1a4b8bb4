"""A bilingual SQL dialect with time travel, compiled to Spark DataFrames."""
