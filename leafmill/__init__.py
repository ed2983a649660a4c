"""PySpark-native analytics over page-structured text, geometry and event records."""
