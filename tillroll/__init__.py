"""Retail customer analytics on Spark: DataFrame in, DataFrame out."""
