"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is cut where no vocabulary piece can reach across: before spaces, at line ends, and between a letter and
a full stop or comma. Each unit starts as its characters; a heap holds the adjacent pairs that form a piece,
best score first, then leftmost; merging links neighbours anew. The count is the number of initial symbols less
the number of merges; a character without a piece of its own counts its UTF-8 bytes (byte fallback).

Nulls count as empty texts (0 bytes, 0 tokens). Repeated rows are counted each. Long units need memory in
proportion to themselves only; counts of units are remembered up to a fixed number of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import own_memory, slices, texts

#: Units remembered by a worker at most, beyond that it starts anew; and the longest that it remembers.
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
SPACE = "▁"
UNIT = re.compile(" *[^ \n]+|\n| +")
#: Between a letter and a full stop or comma.
INNER_CUT = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,])|(?<=[.,])(?=[A-Za-zÀ-ÖØ-öø-ÿ])")


class PieceCounter:
    """Counts tokens as a byte-pair model with byte fallback and a leading space does."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i).replace(SPACE, " "): model.get_score(i) for i in usual}
        scores = {s: rank for rank, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: scores[s] for p, s in pieces.items()}
        if any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) or (len(p) > 1 and INNER_CUT.search(p)) for p in pieces):
            raise ValueError("a piece reaches across a cut")
        self.remembered = remembered
        self.units: dict[str, int] = {}

    def merge_count(self, unit: str) -> int:
        """Tokens of one unit: its symbols less the merges."""
        rank = self.rank.get
        n = len(unit)
        count = sum(1 if c in self.rank else len(c.encode("utf-8")) for c in unit)
        symbols: list[str | None] = list(unit)
        following = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            best, i = divmod(heappop(heap), n)
            left = symbols[i]
            if left is None or (j := following[i]) == n:
                continue
            merged = left + symbols[j]
            if rank(merged) != best:
                continue  # one of the two was merged with another neighbour
            symbols[i], symbols[j] = merged, None
            count -= 1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (r := rank(merged + symbols[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := previous[i]) >= 0 and (r := rank(symbols[h] + merged)) is not None:
                heappush(heap, r * n + h)
        return count

    def _missing(self, unit: str) -> int:
        known = self.units
        total = 0
        for part in INNER_CUT.split(unit) if "." in unit or "," in unit else (unit,):
            n = known.get(part)
            if n is None:
                n = self.merge_count(part)
                if len(part) <= LONGEST_REMEMBERED:
                    known[part] = n
            total += n
        if len(unit) <= LONGEST_REMEMBERED:
            known[unit] = total
        return total

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if len(self.units) > self.remembered:
            self.units.clear()
        get, missing, total = self.units.get, self._missing, 0
        for unit in UNIT.findall(" " + text):
            n = get(unit)
            total += n if n is not None else missing(unit)
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _forget_counters() -> None:
    _counter.cache_clear()


def counter(path: str) -> PieceCounter:
    """One counter a worker process."""
    own_memory(_forget_counters)
    return _counter(path)


def token_counts(
    df: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            for part in slices(batch):
                n = np.array([count(t) for t in texts(part.column(1))], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(n > limit)],
                                                 names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes")
    rows = df.select(id_column, text_column, size)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_column} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
