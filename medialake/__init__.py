"""medialake: a PySpark-native analytics engine for large media and document archives."""
