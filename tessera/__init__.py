"""A PySpark-native engine for exploring and preparing immutable dataset snapshots."""
