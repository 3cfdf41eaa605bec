"""Short-term-rental analytics as Spark DataFrame operators."""
