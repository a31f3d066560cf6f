"""Spark sessions for tests and benchmarks, and what any session needs to run this package's kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let the Python workers of ``spark`` import this package even if the driver was started elsewhere."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])
    return spark


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("readqc")
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share. Only a local session may leave it unset
    (tests): it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="readqc-"))
    return _own_root[0]


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a table in the shared folder, for what is read more than once: computed once, and not lost with an
    executor."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
