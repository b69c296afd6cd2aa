"""Snapshot quality and outlier analytics as Spark DataFrame operators."""
