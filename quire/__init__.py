"""A Spark-native query engine for stores of semi-structured records and for tables read as records."""
