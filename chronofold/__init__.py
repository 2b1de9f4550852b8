"""Repository-history analytics expressed as PySpark DataFrame plans."""
