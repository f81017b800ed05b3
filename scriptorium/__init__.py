"""Spark-native document analytics: declarative operators over DataFrames."""
