"""tidemark: product-analytics operators as PySpark DataFrame functions."""
