"""Spark-native analytics for event-driven series and the dated text around them."""
