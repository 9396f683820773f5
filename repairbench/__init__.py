"""Repair-invoice auditing on Spark: DataFrame in, DataFrame out."""
