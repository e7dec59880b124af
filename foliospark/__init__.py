"""Spark-native document processing and ledger analytics."""
