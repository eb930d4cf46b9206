"""almanac: a PySpark-native engine for recurring weekly schedules and the records around them."""
