"""A Spark-native engine for multimodal training data and benchmark reports."""
