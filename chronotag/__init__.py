"""A tag-set time index and corpus tools on Apache Spark."""
