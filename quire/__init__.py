"""quire: a PySpark-native engine that turns positioned document text into structured, queryable books."""
