"""Repository-history analytics on PySpark."""
