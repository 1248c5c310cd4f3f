"""Next-basket analytics expressed as Spark DataFrame plans."""
