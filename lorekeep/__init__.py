"""A PySpark-native engine for knowledge-base and property-graph analytics."""
