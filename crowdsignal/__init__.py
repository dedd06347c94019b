"""crowdsignal: Spark-native operators over public social posts."""
