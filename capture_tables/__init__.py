"""Capture tables: motion-capture analytics as PySpark DataFrame operators."""
