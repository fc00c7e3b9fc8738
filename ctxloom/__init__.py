"""Analytics over conversation context, on Spark."""
