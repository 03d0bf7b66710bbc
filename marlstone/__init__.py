"""marlstone: a PySpark-native engine for document corpora and the assets they reference."""
