"""A Spark-native SQL script engine with data-preparation operators."""
