"""Panel take-off analytics expressed as Spark DataFrame operators."""
