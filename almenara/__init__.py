"""Public-data analysis as PySpark DataFrame transformations."""
