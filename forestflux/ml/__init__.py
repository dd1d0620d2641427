"""Biomass models on pyspark.ml."""
