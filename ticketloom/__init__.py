"""Support-ticket analytics as PySpark DataFrame operators."""
