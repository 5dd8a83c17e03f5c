"""Vulnerability-signal analytics as PySpark DataFrame operators."""
