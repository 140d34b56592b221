"""Fillwise: Spark-native gap filling for environmental series, and corpus operators in ``fillwise.llm``."""
