"""Spark-first engine for cross-sectional screening of daily bar panels."""
