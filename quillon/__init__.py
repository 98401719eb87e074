"""quillon: a PySpark-native engine for patch-presence evaluation data."""
