"""chronoline: recording analytics as PySpark DataFrame operators."""
