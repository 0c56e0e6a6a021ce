"""Genetic association analytics as Spark DataFrame plans."""
