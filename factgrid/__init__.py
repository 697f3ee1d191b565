"""A PySpark-native engine that checks statements about source code against facts extracted from it."""
