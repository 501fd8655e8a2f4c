"""Stewardry: material master-data governance as Spark DataFrame operators."""
