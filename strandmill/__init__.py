"""Spark-native analytics for single-molecule telomere sequencing data."""
