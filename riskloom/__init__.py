"""riskloom: Spark-native analytics over code, documents and dependency inventories."""
