"""Splits, metrics and Spark ML estimators for the two prediction tasks."""
