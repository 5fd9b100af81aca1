"""Dated-evidence analytics as plain PySpark DataFrame operators."""
