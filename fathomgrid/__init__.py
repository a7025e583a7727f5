"""fathomgrid: a PySpark-native retrieval and knowledge-base analytics engine."""
