"""Spark-native engine for mining, cleaning, sampling and comparing corpora."""
