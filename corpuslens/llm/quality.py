"""Quality scores by compression: dictionaries of good and of bad texts, and which of them helps more.

One zstandard dictionary is trained on labelled good texts, one on bad ones. A text is compressed block by block
with each; the normalised difference of the two sizes, and how far the text can be compressed at all, become a
probability by logistic regression on labelled texts that neither dictionary has seen.

The fit uses at most `per_class` labelled rows of each class outside the held-out fold, of at most `max_chars` characters
(see `labelled_sample`), and draws at most `pieces` pieces from the whole of those texts for each dictionary;
every text is scored whole. Null and empty texts score as a text of no bytes does. Repeated rows score alike. If
one class has no labelled rows the score is the other class's label, 0.5 without any. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out, labelled_sample, logistic, own_memory, slices, texts

PER_CLASS = 2000
MAX_CHARS = 32_768
DICTIONARY = 112_000
#: Bytes of a training piece and of a scored block.
PIECE = 600
#: Pieces of one class's sampled texts that its dictionary is trained on, at most; drawn at random from all of them.
PIECES = 11_200
BLOCK = 1024
LEVEL = 3
#: Bytes that any frame costs.
FRAME = 12
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None


def dictionary(rows: list[bytes], size: int, rng: np.random.Generator, most: int = PIECES) -> bytes:
    """A dictionary trained on `most` random pieces of whole texts; their own content where they are too few to train on."""
    pieces = [t[k : k + PIECE] for t in rows for k in range(0, len(t), PIECE)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))[:most]]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


@lru_cache(maxsize=4)
def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, ...]:
    out = []
    for data in (model.good, model.bad):
        content = zstandard.ZstdCompressionDict(data)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content))
    return tuple(out)


def features(model: Model, text: str) -> tuple[float, float, float]:
    """Normalised difference of sizes (high: the good dictionary helps more), log of the least size per byte, squared."""
    good, bad = compressors(model)
    data = text.encode("utf-8")
    g = b = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        g += len(good.compress(block)) - FRAME
        b += len(bad.compress(block)) - FRAME
    rate = float(np.log((max(min(g, b), 0) + 1) / (len(data) + 1)))
    return (b - g) / (max(b + g, 0) + 1), rate, rate * rate


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS,
        id_column: str = "doc_id", text_column: str = "text", pieces: int = PIECES) -> Model:
    rows = labelled_sample(docs, labels, label, per_class, max_chars, id_column, text_column)
    found = {y for _, y, _ in rows}
    if len(found) < 2:
        return Model(b"", b"", (), (), (), float(found.pop()) if found else 0.5)
    rng = np.random.default_rng(1)
    parts = {}
    for y in (0, 1):
        own = [t.encode("utf-8") for _, z, t in rows if z == y]
        own = [own[i] for i in rng.permutation(len(own))]
        cut = max(1, len(own) // 2)
        parts[y] = own[:cut], own[cut:] or own
    model = Model(dictionary(parts[1][0], DICTIONARY, rng, pieces), dictionary(parts[0][0], DICTIONARY, rng, pieces), (), (), ())
    fresh = [(y, t) for y in (0, 1) for t in parts[y][1]]
    x = np.array([features(model, t.decode("utf-8")) for _, t in fresh])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, np.array([float(y) for y, _ in fresh]))
    return Model(model.good, model.bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def score_text(model: Model, text: str) -> float:
    if model.constant is not None:
        return model.constant
    x = (np.array(features(model, text)) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30))))


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory()
        for batch in batches:
            for part in slices(batch):
                s = np.array([score_text(shared.value, t) for t in texts(part.column(1))], np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 names=[id_column, "score", "predicted"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, score double, predicted int")


def keep(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is predicted good; all rows unless the model has seen both labels."""
    if model.constant is not None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([score_text(shared.value, t) >= threshold for t in texts(part.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fitted on the labels outside the held-out fold."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
