"""Document-intelligence analytics as Spark DataFrame operators."""
