"""Spark-native hotspot analytics: detections in, classified geographic clusters out."""
