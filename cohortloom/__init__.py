"""cohortloom: a PySpark-native engine for linked, multi-modal record collections."""
