"""regspark: a PySpark-native analytics engine for public business registers."""
