"""Retention analytics for subscription businesses, as composable Spark DataFrame plans."""
