"""skyweave: a PySpark-native engine for survey catalogues (see README.md)."""
