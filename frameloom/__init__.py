"""frameloom: a Spark-native engine for time-stamped observation streams."""

__version__ = "0.1.0"
