"""braidflow: a PySpark-native engine for hybrid anomaly analytics on labelled numeric records."""
