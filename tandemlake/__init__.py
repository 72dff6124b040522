"""Spark-native analytics of tandem-repeat-rich sequencing reads."""
