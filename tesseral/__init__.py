"""Spark-native curation of grouped, content-addressed, annotated records."""
