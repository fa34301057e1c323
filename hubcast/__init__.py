"""hubcast — Spark-native trip and event analytics.

Every operator is a function ``DataFrame (+ parameters) -> DataFrame`` built from
Spark SQL expressions, ``pyspark.ml`` stages or Structured Streaming.
"""

from hubcast.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
