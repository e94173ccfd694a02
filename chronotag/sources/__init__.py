"""Where points come from: Parquet, line protocol, generators, files."""
