"""Tallyforge: a PySpark-native engine for document-derived financial data."""
