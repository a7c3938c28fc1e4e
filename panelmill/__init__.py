"""Market-panel analytics as plain Spark DataFrame operators."""
