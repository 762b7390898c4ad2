"""tablewright: a Spark-native engine that inspects data tables and the prose that documents them."""

__version__ = "0.1.0"
