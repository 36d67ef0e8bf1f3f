"""Spark-native curation, context, mining and evaluation for annotated image collections."""
