"""Session settings used by the tests, the benchmark and small local runs.

On a cluster the submitting job owns the session; nothing in the library creates one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # texts are large rows: small Arrow batches keep the Python side of `python_facts` bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # plans name whole folders, however deep a temporary one lies
    "spark.sql.maxMetadataStringLength": "1000",
}

#: of staged tables and packed corpora, which are written once and read few times
COMPRESSION = "zstd"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files: for writes, whose plan no other job uses again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuslens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_folder(spark: SparkSession) -> str:
    """A new folder for staged tables below the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, small runs) gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corpuslens-")
    return f"{shared.rstrip('/')}/staged-{uuid.uuid4().hex}"
