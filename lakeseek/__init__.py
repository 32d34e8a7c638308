"""Spark-native search over Parquet data lakes."""
