"""tessera: a PySpark-native analytics engine for code, SQL and document corpora."""
