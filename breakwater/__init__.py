"""Somatic structural-variant analytics as Spark DataFrame operators."""
