"""Nightjar: a Spark-native engine for event corpora and listening profiles."""
