"""Spark-first measurement engine: candidate tables, spatial joins, densities, reviews and their data quality."""
