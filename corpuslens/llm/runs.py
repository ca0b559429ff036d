"""Periodic runs of words, found with an enhanced suffix array, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q that no neighbouring word extends; runs of at least `LEAST` words
and `TIMES` periods count. Whole batches of documents are treated at once, in arrays:

1. Words become numbers; prefix doubling ranks all suffixes (no prefix is shared beyond a document's end). The ranks
   by 1, 2, 4, ... words are kept: two places start with the same 2^k words of one document if their ranks agree.
   They give the LCP of neighbours in the suffix array, and any extension, by halving steps.
2. Branching tandem test: each entry of the LCP array separates a child from the rest of its LCP interval. The
   suffixes i of the smaller side check by the inverse suffix array whether i + depth and i - depth are on the other
   side: then two equal parts of `depth` words stand side by side and the next word breaks the period. Each
   suffix is on a smaller side at most log n times. Intervals are ranges of the array, no tree is built.
3. Rotate and merge: a branching square ends where its run ends; halving steps rotate it to the left up to the run's
   start. Squares of several periods give the same stretch as those of one, so the least period stays.

A qualified run repeats at least 16 words within its document, so documents whose suffixes all differ in their first
16 words are done after four doublings.

Null and empty texts have no words and no runs. Very long texts need memory in proportion to their words times the
logarithm of their longest repeat. Repeated rows are treated row by row. Rows of a null id are treated like others,
but nothing is planted in them. An empty table gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import ragged, slices, texts

#: A run has at least this many words and this many periods.
LEAST, TIMES = 24, 3
#: The words that every qualified run repeats: of length n >= max(24, 3q), n - q >= 2n/3.
REPEATED_LOG = 4
#: Words of a batch, unless one text holds more, and suffixes tested at a time.
BATCH_WORDS, TESTED = 400_000, 2_000_000


def word_numbers(documents: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in documents]


def suffix_ranks(words: np.ndarray, document: np.ndarray, ends: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks by the first 1, 2, 4, ... words; the last ranks differ all, unless cut off.

    A rank is the first place of its group in the suffix array, so documents follow each other.
    """
    n = len(words)
    order = np.argsort(document * (int(words.max()) + 1) + words, kind="stable") if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (document[order[1:]] != document[order[:-1]])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = starts
    levels, width = [rank], 1
    place = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places of groups that hold more than one suffix
    while len(place) and (rounds is None or len(levels) <= rounds):
        at = order[place]
        beyond = at + width
        second = np.where(beyond < ends[at], rank[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        key, at = key[sort], at[sort]
        order[place] = at
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        rank = rank.copy()
        rank[at] = place[starts]
        levels.append(rank)
        width *= 2
        place = place[~(new & np.r_[new[1:], True])]
    return order, levels


def same(levels: list[np.ndarray], k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether 2^k words from a and from b are equal and within one document; places outside the array: no."""
    n = len(levels[0])
    inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
    rank = levels[k]
    return inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that a suffix shares with the one before it in the suffix array; 0 for a document's first."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = same(levels, k, a, b).astype(np.int64) << k
        a += step
        b += step
    lcp[1:] = b - order[1:]
    return lcp


def sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place r with a positive LCP: r, the first place of the child before it, the end of its interval.

    The child [from, r) shares more than lcp[r] words, all of [from, end) share lcp[r]: children of one interval
    are taken off one by one from the left.
    """
    n = len(lcp)
    least = [lcp]
    while (size := 2 << (len(least) - 1)) <= n:
        half = size // 2
        least.append(np.minimum(least[-1][: n - size + 1], least[-1][half : half + n - size + 1]))
    r = np.flatnonzero(lcp > 0)
    depth = lcp[r]
    first, end = r.copy(), r + 1
    for k in range(len(least) - 1, -1, -1):
        size = 1 << k
        back = first - size
        ok = (back >= 0) & (least[k][np.maximum(back, 0)] > depth)
        first[ok] = back[ok]
        ok = (end + size <= n) & (least[k][np.minimum(end, n - size)] >= depth)
        end[ok] += size
    return r, first - 1, end


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that the next word breaks."""
    n = len(order)
    r, first, end = sides(lcp)
    left = r - first <= end - r
    begin, size = np.where(left, first, r), np.where(left, r - first, end - r)
    other, limit = np.where(left, r, first), np.where(left, end, r)
    total = np.cumsum(size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(r):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TESTED, side="right")))
        node = np.repeat(np.arange(at, stop), size[at:stop])
        suffix = order[ragged(begin[at:stop], size[at:stop])]
        depth = lcp[r[node]]
        for partner in (suffix + depth, suffix - depth):
            inside = (partner >= 0) & (partner < n)
            where = rank[np.where(inside, partner, 0)]
            hit = inside & (where >= other[node]) & (where < limit[node])
            found.append((np.minimum(suffix, partner)[hit], depth[hit]))
        at = stop
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (
        np.zeros(0, np.int64), np.zeros(0, np.int64))


def find_runs(documents: list[np.ndarray]) -> list[np.ndarray]:
    """For each document, given as word numbers, its runs as rows (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(documents)
    numbered = [(i, d) for i, d in enumerate(documents) if len(d) >= LEAST]
    if not numbered:
        return out

    def joined(chosen: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(d) for _, d in chosen])
        stops = np.cumsum(lengths)
        document = np.repeat(np.arange(len(chosen)), lengths)
        return np.concatenate([d for _, d in chosen]), document, stops[document], stops - lengths

    words, document, ends, _ = joined(numbered)
    _, levels = suffix_ranks(words, document, ends, REPEATED_LOG)
    if len(levels) <= REPEATED_LOG:
        return out
    count = np.bincount(levels[REPEATED_LOG], minlength=len(words))
    repeats = np.unique(document[count[levels[REPEATED_LOG]] > 1])
    if not len(repeats):
        return out
    numbered = [numbered[k] for k in repeats.tolist()]
    words, document, ends, begins = joined(numbered)
    order, levels = suffix_ranks(words, document, ends)
    start, period = branching_squares(order, levels[-1], neighbour_lcp(order, levels))
    stop = start + 2 * period
    # what must equal the word one period on: the stretch of the least length without its last period
    length = np.maximum(LEAST, TIMES * period)
    start, compared = stop - length, length - period
    ok = (start >= begins[document[stop - 1]]) & (compared < 1 << len(levels))
    start, stop, period, compared = start[ok], stop[ok], period[ok], compared[ok]
    k = np.frexp(compared.astype(np.float64))[1] - 1  # compared >= 16
    ok = np.zeros(len(start), bool)
    for level in np.unique(k).tolist():
        sel = np.flatnonzero(k == level)
        a, tail = start[sel], compared[sel] - (1 << level)
        ok[sel] = same(levels, level, a, a + period[sel]) & same(levels, level, a + tail, a + tail + period[sel])
    start, stop, period = start[ok], stop[ok], period[ok]
    # each level again as long as it fits: a stretch of any length is rotated in halving steps
    for level in range(len(levels) - 1, -1, -1):
        back = start - (1 << level)
        ok = same(levels, level, back, back + period)
        start = np.where(ok, back, start)
    keep = np.lexsort((period, stop, start))
    start, stop, period = start[keep], stop[keep], period[keep]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    owner = document[start]
    rows = np.stack([start - begins[owner], stop - start, period], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
    cuts = np.searchsorted(np.sort(owner), np.arange(len(numbered) + 1))
    for k, (i, _) in enumerate(numbered):
        out[i] = rows[cuts[k] : cuts[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the most periods; of ties the first, then that of the smallest period."""
    return min(map(tuple, runs.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the checksum of its id, made periodic from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _documents(batch: pa.RecordBatch, planted: bool) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[np.ndarray]]]:
    """Slices of a batch with the words and the runs of their rows."""
    def treated(rows: pa.RecordBatch, held: list[list[bytes]]):
        return rows, held, find_runs(word_numbers(held))

    for part in slices(batch, 64):
        held, size, at = [], 0, 0
        for i, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), texts(part.column(1)))):
            words = text.encode("utf-8").split()  # bytes: the blanks of ASCII only
            words = plant(words, doc_id) if planted else words
            if held and size + len(words) > BATCH_WORDS:
                yield treated(part.slice(at, i - at), held)
                held, size, at = [], 0, i
            held.append(words)
            size += len(words)
        if held:
            yield treated(part.slice(at), held)


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, start, length, period: a row for each run of each text, in numbers of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, found in _documents(batch, False):
                rows = np.concatenate(found)
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), *(pa.array(rows[:, k]) for k in range(3))],
                    names=[id_column, "start", "length", "period"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, start bigint, length bigint, period bigint")


def collapse(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text: the words of every text, joined by blanks, with all but the first period of each run left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, found in _documents(batch, False):
                out = [_collapsed(w, f).decode("utf-8") for w, f in zip(words, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[id_column, "text"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, text string")


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    if not len(found):
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()])


def run_digests(df: DataFrame, planted: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_runs, the strongest run with its exponent, digests of all runs and of the collapsed text.

    With `planted`, texts are first made periodic by `plant`.
    """
    kinds = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
             "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, found in _documents(batch, planted):
                out = []
                for w, f in zip(words, found):
                    best = strongest(f)
                    start, length, period = best or (None, None, None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in f.tolist())
                    out.append((len(f), start, length, period, 1000 * length // period if best else None,
                                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapsed(w, f)).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, kind) for v, kind in zip(zip(*out), kinds.values()))], names=[id_column, *kinds])

    rows = df.select(id_column, text_column)
    columns = ", ".join(f"{c} {'string' if kind == pa.string() else 'bigint'}" for c, kind in kinds.items())
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, {columns}")
