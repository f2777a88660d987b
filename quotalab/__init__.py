"""Spark-native inventory-allocation analytics."""
