"""tessera: a PySpark-native engine for document retrieval and corpus analytics."""
