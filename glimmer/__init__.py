"""Early-signal evidence analytics as Spark DataFrame operators."""
