"""A PySpark-native engine that turns report documents into tables of key figures."""
