"""Process-mining analytics on Spark: event tables in; relations, models and conformance results out."""
