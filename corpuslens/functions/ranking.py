"""First n rows per key, and joins of many rows with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int | None = None,
) -> DataFrame:
    """Join many rows per key to at most one row per key.

    The single row is repeated for every salt and the many rows are spread over the salts by a hash
    of ``spread``, so a key with a third of all rows becomes ``salts`` tasks: as many as the session
    shuffles into, unless given.  The hash is of the data, so a retried task computes the same rows.
    """
    salts = salts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank (1-based).

    The rank filter sits right on the window, so Spark limits every map task to ``n`` rows per
    key before the shuffle (``WindowGroupLimit``): a key with a third of all rows sends at most
    ``n`` rows per map task, not the whole group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_n(df: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Q2: a view's first ``n`` rows per repository."""
    return top_n(df, keys or ["repo_id"], order, n)

