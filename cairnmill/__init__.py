"""A Spark-native index and data-preparation engine for Markdown knowledge bases."""
