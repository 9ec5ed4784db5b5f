"""Pose-graph and range-scan map analytics on PySpark."""
