"""Spark-native analytics over lakehouse tables and streams."""
