"""A PySpark-native engine for batch lakehouse work: typed ingestion, validation, versioned tables, data products, ML data."""
