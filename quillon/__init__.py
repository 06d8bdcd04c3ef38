"""A PySpark-native engine for cleaning, restructuring and re-rendering text and HTML at scale."""
