"""tapeloom: Spark-native analytics over append-only market tape."""

__version__ = "0.1.0"
