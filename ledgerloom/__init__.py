"""A Spark-native engine for ledger analytics."""
