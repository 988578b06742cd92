"""News sentiment analytics on PySpark: cleaning, profiling, features, scoring, streams."""
