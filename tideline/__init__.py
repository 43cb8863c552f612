"""A PySpark-native SQL analytics and query-intelligence engine."""
