"""logloom: a PySpark-native engine for coding-agent session logs."""
