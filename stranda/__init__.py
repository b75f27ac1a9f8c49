"""A Spark-native analytics engine for high-throughput sequencing data."""
