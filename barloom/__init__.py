"""A Spark-native analytics engine for panels of time-series bars."""
