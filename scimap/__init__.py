"""scimap: a PySpark-native scientometric analytics engine."""
