"""tallygrid: Spark-native profiling, topic consolidation and feature pipelines."""
