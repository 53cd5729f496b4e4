"""Cardinality, plan-quality and corpus analytics expressed on Spark DataFrames."""
