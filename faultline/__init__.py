"""Incident and log analytics on Spark: every operator is a DataFrame -> DataFrame function."""
