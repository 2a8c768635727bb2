"""Spark-native code-intelligence engine: index source trees, resolve calls, search, walk, rank and maintain them as DataFrames."""
