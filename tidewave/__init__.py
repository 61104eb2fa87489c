"""Tidewave: Spark-native analytics for long, regularly sampled recordings."""
