"""recordloom: Spark-native cleaning, filtering, scoring and auditing of record tables."""
