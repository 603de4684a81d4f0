"""quire: a PySpark-native engine for versioned collections of serialized text."""
