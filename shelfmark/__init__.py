"""shelfmark: a PySpark-native analytics engine for file and document catalogues."""
