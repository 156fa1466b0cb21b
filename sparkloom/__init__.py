"""Spark-native analytics engine for investment-manager intake, scoring and reporting."""
