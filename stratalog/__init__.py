"""Multi-version, ordered key-value analytics on PySpark."""
