"""Temporal fact analytics expressed as Spark DataFrame operators."""
