"""quantloom: a Spark-native engine for cross-sectional time-series research."""
