"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JIT leaves methods above 8000 bytes interpreted; wide projections run faster in smaller pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording the source line of every column call costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    name: str = "twinfold", cpus: str = "*", partitions: int = 8, memory: str = "8g", more: dict | None = None
) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {**SETTINGS, **(more or {})}.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
