"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

The bins are planned on the histogram of lengths, which has at most `capacity` entries whatever the number of
documents: a bin is filled greedily with the longest documents that fit; then its smallest document gives way
to two unpacked ones if these fill the widened gap more tightly. A filled bin is a pattern (how many documents
of which lengths) that is used as often as the histogram allows, so each pattern leaves some length with fewer
documents than it needs: the plan's size depends on the capacity, not on the corpus. Documents then find their
place by their rank within their length. Ranks are counted in salted groups of a length, so no length meets in
one task.

Nulls count as empty texts and give one piece (the end token alone). Only documents beyond the capacity are
cut. Repeated rows are packed each. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import slices, stage, texts, width
from corpuslens.llm.word_bpe import codec

CAPACITY = 4096
END_TOKEN = 1


def token_pieces(
    df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id, piece, start, length, ids_crc32: the documents' token sequences, cut only beyond the capacity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                source, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(bpe.encode(texts(part.column(1)))):
                    ids = np.append(ids, np.array([end_token], "<u4"))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity]
                        source.append(row)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(v, pa.int64()) for v in (start, length, crc))],
                    names=[id_column, "piece", "start", "length", "ids_crc32"])

    rows = df.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_column} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Pattern:
    """A way to fill a sequence: (length, how many) from left to right, and how many sequences are filled so."""

    parts: list[tuple[int, int]]
    times: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-two-fit on counts of lengths."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    sizes = np.arange(capacity + 1)
    patterns = []
    while count.any():
        left = count.copy()
        # the longest length in stock that is at most the index; 0: none
        best = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        parts: dict[int, int] = {}
        gap = capacity
        while gap and (size := int(best[gap])):
            n = int(min(gap // size, left[size]))
            parts[size] = n
            left[size] -= n
            gap -= n * size
            if not left[size]:
                best = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        if gap:
            smallest = min(parts)
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1])
            if len(first):
                second = best[room - first]
                # two of one length need two in stock; else the next shorter one
                same = (second == first) & (left[first] < 2)
                shorter = np.r_[0, best[:-1]]
                second[same] = shorter[second[same]]
                total = np.where(second > 0, first + second, 0)
                k = int(np.argmax(total))
                if total[k] > smallest:
                    parts[smallest] -= 1
                    for size in (int(first[k]), int(second[k])):
                        parts[size] = parts.get(size, 0) + 1
        parts = {size: n for size, n in parts.items() if n}
        times = min(int(count[size]) // n for size, n in parts.items())
        for size, n in parts.items():
            count[size] -= n * times
        patterns.append(Pattern(sorted(parts.items(), reverse=True), times))
    return patterns


def segments(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length and pattern: the first rank it takes, and where these documents go. Sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for size, n in p.parts:
            rows.append((size, taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + n * p.times
            offset += size * n
        sequence += p.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "uses", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, length, ...); lengths are 1 to `capacity`."""
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(id_column), "piece", "start"), F.lit(4 * width(spark))).cast("int"))
    groups = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = segments(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy(id_column, "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).select(*pieces.columns, "rank")

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lengths fit in 20 bits, ranks in 43
        keys = (plan["length"] << 43) | plan["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 43) | rank, side="right") - 1
            number = rank - plan["rank"][at]
            uses = plan["uses"][at]
            sequence = plan["sequence"][at] + number // uses
            offset = plan["offset"][at] + number % uses * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{columns}, sequence_id bigint, offset bigint")


def pack_documents(
    df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(df, vocabulary, capacity, end_token, id_column, text_column), capacity, id_column)
