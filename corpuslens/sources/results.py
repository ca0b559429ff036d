"""Keep, fetch and delete the results of one repository.

Tables are Parquet, partitioned by a hash bucket of ``repo_id`` rather than by the id itself, so a
million repositories do not become a million folders.  Writing and deleting replace only the
buckets they touch (dynamic partition overwrite).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows that a bucket holds when a store is made with its first table
ROWS_PER_BUCKET = 1_000_000
#: the folder, beside the buckets' own, that keeps their number; readers of the table pass over it
COUNT = "_buckets"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # a store that cannot be read must not be taken for an empty one, and be overwritten
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets that the store was made with; None if there is no store yet."""
    found = _read(spark, f"{path}/{COUNT}")
    return None if found is None else found.first()["buckets"]


def _replace_buckets(rows: DataFrame, path: str) -> None:
    # rebalance writes few files per bucket and still splits a bucket that is too large
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "repo_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def write_results(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store a result table; repositories that are already stored are replaced.

    The number of buckets is kept beside the table when it is made: as given, or by the number of its rows. The
    table is written to a folder of its own first, so that it is computed once.
    """
    spark = df.sparkSession
    staged = f"{path}/_new-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    new = spark.read.schema(df.schema).parquet(staged)
    stored = _buckets(spark, path)
    if stored is None:
        stored = buckets or max(1, -(-new.count() // ROWS_PER_BUCKET))
        spark.createDataFrame([(stored,)], "buckets int").write.parquet(f"{path}/{COUNT}")
        old = None
    else:
        old = spark.read.parquet(path)
    new = new.withColumn("bucket", _bucket(stored))
    if old is not None:
        others = (
            old.where(F.col("repo_id").isNotNull())
            .join(new.select("bucket").distinct(), "bucket", "left_semi")
            .join(new.select("repo_id").distinct(), "repo_id", "left_anti")
        )
        new = new.unionByName(others)
    _replace_buckets(new, path)


def _bucket_of(spark: SparkSession, path: str, repo_id: str) -> int:
    buckets = _buckets(spark, path)
    if buckets is None:
        raise ValueError(f"no results at {path}")
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(repo_id)), F.lit(buckets)).cast("int")).first()[0]


def read_result(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """One repository: partition pruning on the bucket, then row-group statistics on the id."""
    bucket = _bucket_of(spark, path, repo_id)
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("repo_id") == repo_id)).drop("bucket")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("repo_id").isNotNull()).drop("bucket")


def drop_result(spark: SparkSession, path: str, repo_id: str) -> None:
    """Delete one repository by rewriting its bucket.

    A row without ``repo_id`` keeps a bucket that becomes empty from being left as it was; reads
    never show it.
    """
    bucket = _bucket_of(spark, path, repo_id)
    stored = spark.read.parquet(path)
    rest = stored.where((F.col("bucket") == bucket) & (F.col("repo_id") != repo_id))
    marker = spark.range(1).select(*[
        F.lit(bucket).alias("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema])
    _replace_buckets(rest.unionByName(marker), path)
