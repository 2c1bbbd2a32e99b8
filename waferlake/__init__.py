"""Wafer-test analytics expressed as Spark DataFrame plans."""
