"""A PySpark-native analytics engine for program-reconstruction data."""
