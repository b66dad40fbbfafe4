"""Trajectory analytics on Spark: graphs, reward statistics, evaluation tables and dataset building."""
