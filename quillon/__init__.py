"""A Spark-native engine for sales and tick data."""
