"""Terrain site search as Spark DataFrame operators."""
