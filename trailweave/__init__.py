"""Evidence-to-finding analytics as PySpark DataFrame operators."""
