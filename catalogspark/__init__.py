"""catalogspark: incremental catalogue indexing and training-data operators on Spark."""
