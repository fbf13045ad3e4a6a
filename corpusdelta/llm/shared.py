"""New folders in the place that the driver and all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession

from corpusdelta.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
