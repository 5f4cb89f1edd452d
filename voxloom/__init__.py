"""voxloom: Spark-native analytics over segmented 3-D volumes."""

__all__ = ["bindings", "catalog", "functions", "operators", "plans", "sinks", "sources", "streaming", "support"]
