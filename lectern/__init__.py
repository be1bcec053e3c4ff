"""A PySpark-native analytics engine for study material and learner activity."""
