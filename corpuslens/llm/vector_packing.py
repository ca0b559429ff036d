"""Vector bin packing of tokenised examples: tokens, segments and loss-bearing tokens have a limit each.

1. Every example (optional prompt, text, end token) is tokenised; the prompt bears no loss. An example beyond a limit
   is cut into pieces within the limits. A piece as long as a sequence is one, the others are dealt by a hash into
   groups of about `GROUP_TOKENS` tokens, so that no group grows with the corpus.
2. In a group, one sequence after another is filled: of the pieces that fit, the one whose demands, times what is
   left of each limit, times the mean demand for it, sum up highest (the dot product) comes next.
3. When nothing fits any more, the longest piece left is cut to fill the gap. A sequence that a limit other than that
   on tokens closes, or that takes a group's last pieces, is cut back to a power of two, as such a sequence needs no
   padding either; what is cut off comes first in the sequences that follow. So no sequence has any padding.

Groups are packed in tasks of their own; ids travel with the pieces, so no text is tokenised twice.

Null texts count as empty and give one piece, the end token. Null prompts count as empty. Repeated rows, also those of
a null id, are packed each; ids may repeat. An empty table gives no rows. Other columns are not read. Very long texts
need memory in proportion to themselves in the task that tokenises them, nowhere else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import slices, stage, texts, width
from corpuslens.llm.word_bpe import codec

END_TOKEN = 2
#: Tokens of a group of pieces that one task packs at a time.
GROUP_TOKENS = 2_000_000


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


def cut_points(n: int, prompt: int, limits: Limits) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest pieces within the limits, from the left; the first `prompt` tokens bear no loss."""
    at = 0
    while at < n:
        end = min(n, at + limits.tokens, max(prompt, at) + limits.loss)
        yield at, end
        at = end


def example_pieces(
    df: DataFrame, vocabulary: str, limits: Limits = Limits(), end_token: int = END_TOKEN, id_column: str = "doc_id",
    text_column: str = "text", prompt_column: str | None = None,
) -> DataFrame:
    """id, row, start, length, loss, doc_tokens, ids: pieces within the limits; ids little-endian, 16 or 32 bits each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        kind = np.dtype(bpe.small).newbyteorder("<")
        row, no_ids = TaskContext.get().partitionId() << 33, np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                source, rows, total, ids_of = [], [], [], []
                spans: list[tuple[int, int, int]] = []
                heads = list(bpe.encode(texts(part.column(2)))) if prompt_column else [no_ids] * part.num_rows
                for i, (head, ids) in enumerate(zip(heads, bpe.encode(texts(part.column(1))))):
                    ids = np.concatenate([head, ids, [end_token]]).astype(kind)
                    for at, end in cut_points(len(ids), len(head), limits):
                        source.append(i)
                        rows.append(row)
                        row += 1
                        spans.append((at, end - at, max(0, end - max(at, len(head)))))
                        total.append(len(ids))
                        ids_of.append(ids[at:end].tobytes())
                numbers = np.array(spans, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int64())), pa.array(rows, pa.int64()),
                     *(pa.array(numbers[:, k]) for k in range(3)), pa.array(total, pa.int64()), pa.array(ids_of, pa.binary())],
                    names=[id_column, "row", "start", "length", "loss", "doc_tokens", "ids"])

    rows = df.select(id_column, text_column, *([prompt_column] if prompt_column else []))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_column} {kind}, row bigint, start bigint, length bigint, loss bigint, doc_tokens bigint, ids binary")


class Stock:
    """Pieces not packed yet, by (tokens, loss); pieces alike are taken in order."""

    def __init__(self, demands: np.ndarray, limits: Limits):
        self.kinds, kind = np.unique(demands, axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        self.left = np.bincount(kind.ravel(), minlength=len(self.kinds))
        self.next = np.cumsum(self.left) - self.left
        self.items = order
        share = np.c_[self.kinds[:, 0] / limits.tokens, np.full(len(self.kinds), 1 / limits.segments), self.kinds[:, 1] / limits.loss]
        mean = (share * self.left[:, None]).sum(0) / max(1, self.left.sum())
        #: demands as shares of the limits, times their mean
        self.weighted = share * mean
        self.total = int(self.left.sum())

    def _take(self, kind: int) -> int:
        item = int(self.items[self.next[kind]])
        self.next[kind] += 1
        self.left[kind] -= 1
        self.total -= 1
        if not self.left[kind] and (self.left > 0).sum() * 2 < len(self.left):
            alive = self.left > 0  # fewer kinds to look at from here on
            self.kinds, self.left, self.next, self.weighted = (x[alive] for x in (self.kinds, self.left, self.next, self.weighted))
        return item

    def best(self, tokens: int, loss: int, room: np.ndarray) -> int | None:
        """A piece of at most so many tokens and so much loss with the largest dot product with the room left."""
        score = np.where((self.left > 0) & (self.kinds[:, 0] <= tokens) & (self.kinds[:, 1] <= loss), self.weighted @ room, -1.0)
        kind = int(np.argmax(score)) if len(score) else 0
        return self._take(kind) if len(score) and score[kind] >= 0 else None

    def longest(self) -> int:
        return self._take(int(np.flatnonzero(self.left > 0)[-1]))


def pack_pieces(length: np.ndarray, loss: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, tokens, sequence, offset): every token of every piece once; a piece's loss is at its end."""
    stock = Stock(np.stack([length, loss], 1), limits)
    free = length - loss  # tokens of a piece that bear no loss stand first
    open_: list[tuple[int, int]] = []  # (piece, start) of what was cut off
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def loss_of(piece: int, start: int, tokens: int) -> int:
        return max(0, start + tokens - max(start, int(free[piece])))

    while stock.total or open_:
        placed: list[tuple[int, int, int]] = []
        tokens, segments, losses = limits.tokens, limits.segments, limits.loss

        def place(piece: int, start: int, n: int) -> None:
            nonlocal tokens, segments, losses
            placed.append((piece, start, n))
            tokens, segments, losses = tokens - n, segments - 1, losses - loss_of(piece, start, n)

        def place_prefix(piece: int, start: int) -> None:
            """As much of a piece as fits; the rest stays open."""
            end = min(int(length[piece]), start + tokens, max(start, int(free[piece])) + losses)
            if end > start:
                place(piece, start, end - start)
            if end < length[piece]:
                open_.append((piece, max(start, end)))

        waiting, open_ = open_, []
        for piece, start in waiting:
            if tokens and segments:
                place_prefix(piece, start)
            else:
                open_.append((piece, start))
        while tokens and segments:
            room = np.array([tokens / limits.tokens, segments / limits.segments, losses / limits.loss])
            piece = stock.best(tokens, losses, room)
            if piece is None:
                break
            place(piece, 0, int(length[piece]))
        if tokens and segments and stock.total:
            place_prefix(stock.longest(), 0)
        used = limits.tokens - tokens
        if used < limits.tokens and used & (used - 1):
            excess = used - (1 << (used.bit_length() - 1))
            while excess:
                piece, start, n = placed.pop()
                drop = min(n, excess)
                excess -= drop
                if drop < n:
                    placed.append((piece, start, n - drop))
                open_.append((piece, start + n - drop))
        # what a piece lost in one go stays in one: of its open parts, the first reaches to the end
        first: dict[int, int] = {}
        for piece, start in open_:
            first[piece] = min(start, first.get(piece, start))
        open_ = list(first.items())
        offset = 0
        for piece, start, n in placed:
            out.append((piece, start, n, sequence, offset))
            offset += n
        sequence += 1
    return out


def pack(pieces: DataFrame, limits: Limits = Limits(), group_tokens: int = GROUP_TOKENS, id_column: str = "doc_id") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset; from `example_pieces`."""
    pieces = stage(pieces, "examples")
    kind = pieces.schema[id_column].dataType.simpleString()
    whole = F.col("length") == limits.tokens
    total = pieces.where(~whole).agg(F.sum("length")).first()[0] or 0
    groups = -(-total // group_tokens) or 1
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    schema = f"{id_column} {kind}, " + ", ".join(f"{c} bigint" for c in names[1:])

    def numbers(table: pa.Table | pa.RecordBatch, *columns: str) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in columns]

    def words(ids: bytes, n: int) -> np.ndarray:
        return np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, length = numbers(part, "row", "length")
                crc = [zlib.crc32(words(ids, n)) for ids, n in zip(part.column("ids").to_pylist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column("start"), part.column("length"), pa.array(crc, pa.int64()),
                     part.column("doc_tokens"), part.column("loss"), pa.array(-1 - row), pa.array(np.zeros(len(row), np.int64))],
                    names=names)

    def together(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")  # the same plan if a task is run again
        length, loss, start = numbers(table, "length", "loss", "start")
        found = np.array(pack_pieces(length, loss, limits), np.int64).reshape(-1, 5)
        found = found[np.argsort(found[:, 0], kind="stable")]
        crc, at, held = [], -1, None
        ids = table.column("ids")
        for piece, begin, n, *_ in found.tolist():
            if piece != at:
                at, held = piece, words(ids[piece].as_py(), int(length[piece]))
            crc.append(zlib.crc32(held[begin : begin + n]))
        piece, begin, n = found[:, 0], found[:, 1], found[:, 2]
        bears = np.maximum(0, begin + n - np.maximum(begin, (length - loss)[piece]))
        source = table.select([id_column, "doc_tokens"]).take(pa.array(piece))
        return pa.table([source.column(0), pa.array(start[piece] + begin), pa.array(n), pa.array(crc, pa.int64()), source.column(1),
                         pa.array(bears), pa.array((int(key[0].as_py()) << 32) + found[:, 3]), pa.array(found[:, 4])], names=names)

    dealt = pieces.where(~whole).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    # a few groups a task, however many there are
    packed = dealt.repartition(max(width(pieces.sparkSession), -(-groups // 4)), "group").groupBy("group").applyInArrow(together, schema)
    full = pieces.where(whole).select(id_column, "row", "start", "length", "loss", "doc_tokens", "ids").mapInArrow(alone, schema)
    return full.unionByName(packed)


def pack_examples(
    df: DataFrame, vocabulary: str, limits: Limits = Limits(), end_token: int = END_TOKEN, id_column: str = "doc_id",
    text_column: str = "text", prompt_column: str | None = None,
) -> DataFrame:
    """Every piece of every example with its place; see `pack`."""
    return pack(example_pieces(df, vocabulary, limits, end_token, id_column, text_column, prompt_column), limits, id_column=id_column)
