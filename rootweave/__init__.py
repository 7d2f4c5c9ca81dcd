"""Root-system analytics as Spark DataFrame operators."""
