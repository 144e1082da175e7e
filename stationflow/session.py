"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "stationflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are planned for.

    Only defaults are set here; the cluster's own configuration wins where
    it is already present.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach.

    The root is the folder named by ``spark.checkpoint.dir``; where that is
    unset, a folder in the warehouse, which a session shares with its
    executors as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stationflow-shared"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
