"""Sparquill: a PySpark-native engine for developer-activity and code-intelligence tables."""
