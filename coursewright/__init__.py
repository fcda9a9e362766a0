"""coursewright: a PySpark-native engine for course-catalog analytics."""
