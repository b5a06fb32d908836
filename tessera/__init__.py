"""Spark-native analytics engine: predicates over nested records, keyed tables, statistics, scalar functions, spherical geometry."""
