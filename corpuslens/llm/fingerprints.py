"""Document fingerprints by winnowing.

Every run of `k` code points has a rolling hash; of every window of `window` successive hashes the smallest is
chosen, the rightmost of equal ones, and kept with its position once. Two texts that share `k + window - 1` code
points share a fingerprint entry. A text shorter than `k` has one entry, its own hash at position 0; an empty
text has none. A text with fewer than `window` hashes is one window.

A fingerprint is written as `hash:position` entries (hash in 10 hexadecimal digits), comma-joined. The likeness
of two fingerprints is the Jaccard index of their sets of hashes; two empty ones are alike (1.0). Nulls count as
empty texts. Equal texts have equal fingerprints. Long texts are hashed block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuslens.llm.common import slices, texts, width

K = 24
WINDOW = 64
#: Hashes of one block of a long text.
BLOCK = 1 << 18
HASH_BITS = 40
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(FACTOR, BLOCK + 4096)
_INVERSE = _powers(np.uint64(pow(int(FACTOR), -1, 1 << 64)), BLOCK + 4096)


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of k code points, mixed; from prefix sums."""
    values = (points.astype(np.uint64) + np.uint64(1)) * MIX
    values ^= values >> np.uint64(29)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWERS[: len(values)], out=prefix[1:])
    runs = len(values) - k + 1
    out = (prefix[k:] - prefix[:-k]) * _INVERSE[:runs]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out >> np.uint64(64 - HASH_BITS)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every `window` successive keys, by doubling."""
    span = 1
    out = keys
    while 2 * span <= window:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < window:
        out = np.minimum(out[: len(out) - (window - span)], out[window - span :])
    return out


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that are chosen, by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < k:
        return rolling_hashes(points, n), np.zeros(1, np.int64)
    hashes, positions = [], []
    last = -1
    runs = n - k + 1
    mask = np.uint64((1 << (64 - HASH_BITS)) - 1)
    for at in range(0, max(1, runs - window + 1), BLOCK):
        h = rolling_hashes(points[at : at + BLOCK + window - 1 + k - 1], k)
        # of equal hashes the rightmost is the smallest key
        keys = (h << np.uint64(64 - HASH_BITS)) | (mask - np.arange(len(h), dtype=np.uint64))
        best = window_minima(keys, min(window, len(keys)))
        where = (mask - (best & mask)).astype(np.int64)
        where = where[np.r_[True, where[1:] != where[:-1]]]
        where = where[where + at > last]
        if len(where):
            last = int(where[-1]) + at
        hashes.append(h[where])
        positions.append(where + at)
    return np.concatenate(hashes), np.concatenate(positions)


def written(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join([f"{h:010x}:{p}" for h, p in zip(chosen[0].tolist(), chosen[1].tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(
    df: DataFrame, k: int = K, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id, n_chars, fingerprint of every text; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = texts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in rows], pa.int64()),
                     pa.array([written(winnow(t, k, window)) for t in rows], pa.string())],
                    names=[id_column, "n_chars", "fingerprint"])

    rows = df.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_column} {kind}, n_chars bigint, fingerprint string")


def with_next(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, part, ghost: rows dealt into ranges of descending id and sorted there.

    The first document of each range also stands, as a ghost, behind the last of the range before it (that of the
    first range behind the last range), so each task sees the next document of all its own. Ranges are cut at
    quantiles of the ids; rows of a repeated id stay in one range, by text; null ids come last.
    """
    spark = df.sparkSession
    parts = 2 * width(spark)
    rows = df.select(F.col(id_column), F.coalesce(text_column, F.lit("")).alias(text_column))
    splits = sorted(set(df.select(id_column).approxQuantile(id_column, [i / parts for i in range(1, parts)], 0.2 / parts)))
    not_above = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s >= F.col(id_column))) if splits else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col(id_column).isNull(), len(splits) + 1).otherwise(not_above).cast("int"))
    # at most two rows more than there are ranges
    heads = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.max(id_column).alias("first")).collect())
    kind = df.schema[id_column].dataType.simpleString()
    before = spark.createDataFrame(
        [(p, first, heads[i - 1][0]) for i, (p, first) in enumerate(heads)], f"head_part int, head_id {kind}, before int")
    heads_join = (F.col("part") == F.col("head_part")) & F.col(id_column).eqNullSafe(F.col("head_id"))
    own, ghost = F.struct("part", F.lit(False).alias("ghost")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost"))
    placed = rows.join(F.broadcast(before), heads_join, "left").select(
        id_column, text_column,
        F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("place"))
    placed = placed.select(id_column, text_column, "place.part", "place.ghost")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last(id_column), text_column)


def edited_fingerprints(
    df: DataFrame, k: int = K, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to that and to the next document.

    The edited text keeps all code points but the last n // 2, which as many of the next document's (or all it
    has) replace. The next document is that of the next smaller id; after the last comes the first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # the row that waits for its next document

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

        for batch in batches:
            for part in slices(batch):
                for row in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist(),
                               part.column(3).to_pylist()):
                    i, text, place, ghost = row
                    chosen = winnow(text, k, window)
                    if held is not None and held[2] == place and not held[3]:
                        n = len(held[1])
                        new = held[1][: n - n // 2] + text[: n // 2]
                        own, after = held[4], winnow(new, k, window)
                        out.append((
                            held[0], n, hashlib.sha256(new.encode("utf-8")).hexdigest(), written(own), written(after),
                            likeness(own[0], after[0]), likeness(own[0], chosen[0])))
                    held = (i, text, place, ghost, chosen)
                if out:
                    yield flush()
                    out.clear()

    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [to_arrow_type(df.schema[id_column].dataType), pa.int64(), pa.string(), pa.string(),
             pa.string(), pa.float64(), pa.float64()]
    schema = (f"{id_column} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return with_next(df, id_column, text_column).mapInArrow(run, schema)
