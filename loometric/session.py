"""Session for local runs, and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8", checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loometric")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which names storage that the driver and every executor see.

    Where that is unset, a session on one machine uses its warehouse (``spark.sql.warehouse.dir``); a cluster's session raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
