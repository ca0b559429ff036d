"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
#: In a worker process: how to forget what the operator that runs in it remembers.
_forget: list[Callable[[], None]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="llm-"))
        shared = _local[0]
    return shared.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new place in the shared folder and read it back.

    Cuts the lineage: what was computed once stays the same if an executor is lost later.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_memory(forget: Callable[[], None] | None = None) -> None:
    """Called where a task starts: one worker process serves many operators, and only the present one's memory stays.

    `forget` drops what this operator remembers from task to task; it runs when another operator's task starts here.
    """
    if _forget and _forget[0] is not forget:
        _forget.pop()()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    if forget is not None:
        _forget[:] = [forget]


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from: crc32 of the id's digits is a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of an Arrow batch, so that only a few texts are Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int,
    id_column: str = "doc_id", text_column: str = "text",
) -> list[tuple[int, int, str]]:
    """(id, label, text) of at most `per_class` labelled rows of each class, for fitting a model on the driver.

    Rows whose id falls into the held-out fold, labels other than 0 and 1, ids labelled both, and texts beyond `max_chars`
    take no part; rows are taken by a hash of their id, equal texts once. At most 2 * per_class ids are broadcast, and as
    many texts collected: of an id that stands more than once, the least text.
    """
    fold = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(
        F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    chosen = None
    for y in (0, 1):
        part = fold.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(
        F.min("text").alias("text")).collect()
    out, seen = [], set()
    for r in sorted(rows, key=lambda r: (r["id"], r["text"])):
        if r["text"] not in seen:
            seen.add(r["text"])
            out.append((r["id"], r["y"], r["text"]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept first, by Newton's steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
