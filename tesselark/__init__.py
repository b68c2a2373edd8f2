"""Spark-native analytics over numeric planes, blocks and token streams."""
