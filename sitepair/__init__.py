"""A PySpark-native analytics engine for multilingual site migration."""
