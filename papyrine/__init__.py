"""Spark-native document structuring: layout, metadata, sections, visuals and evaluation as DataFrame plans."""
