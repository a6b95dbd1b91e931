"""feedloom: a Spark-native engine for content feeds, near-duplicate merging and training-data preparation."""
