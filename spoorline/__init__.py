"""Spark-native analytics over runtime event logs, call graphs and program-behaviour graphs."""
