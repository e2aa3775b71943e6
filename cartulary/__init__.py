"""PySpark-native engine for versioned, evidence-backed catalogues."""
