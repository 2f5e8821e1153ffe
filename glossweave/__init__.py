"""Spark-native lexical graph and corpus analytics."""
