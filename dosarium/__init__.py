"""Spark-native planning of document routing: DataFrame in, DataFrame out."""
