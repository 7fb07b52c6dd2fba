"""Spark-native triage of binary and text corpora: DataFrame operators keyed by ``binary_id``."""
