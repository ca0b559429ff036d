"""Findings of round 4 on disk: staged tables and packed corpora leave no shuffle files and are packed tightly."""

import pytest
from pyspark.sql import functions as F

from corpuslens.plans.analysis import stored
from corpuslens.sources.corpus import write_corpus
from tests.conftest import rows_of

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {kept.apply(i).getName() for i in range(kept.size()) if kept.apply(i).getName().startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark, tmp_path, make_files):
    before, setting = _shuffle_files(spark), spark.conf.get(KEY)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored(str(tmp_path / "s"))("counted", counted).count() == 7
    write_corpus(make_files({f"d/{i}.py": "x" for i in range(20)}), str(tmp_path / "c"), partitions=3)
    read = spark.read.parquet(str(tmp_path / "c"))
    assert rows_of(read.where("path = 'd/1.py'"), "repo_id", "path", "content", "dir", "name", "ext") == [("r", "d/1.py", "x", "d", "1.py", ".py")]
    # counting what was read back is a job outside, one of whose files may still be there
    assert len(_shuffle_files(spark) - before) <= 8 and spark.conf.get(KEY) == setting
    assert all(f.name.endswith(".zstd.parquet") for d in ("s/counted", "c") for f in (tmp_path / d).glob("*.parquet"))


def test_a_failed_write_restores_the_setting(spark, tmp_path):
    setting = spark.conf.get(KEY)
    with pytest.raises(Exception):
        stored(str(tmp_path))("x", spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(KEY) == setting
