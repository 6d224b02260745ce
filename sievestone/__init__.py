"""sievestone: a PySpark-native engine for data governance, user analytics and corpus preparation."""
