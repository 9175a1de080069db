"""Spark-native preparation and evaluation of ordinal-outcome studies."""
