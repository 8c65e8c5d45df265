"""Change-risk analytics and corpus evaluation as PySpark DataFrame plans."""
