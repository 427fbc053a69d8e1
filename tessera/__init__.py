"""Spark-native supervised binning."""
