"""A PySpark-native engine for analysing source code and text as tables."""
