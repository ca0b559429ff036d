"""Collocations: phrases of two and three words that stand together more often than their parts suggest.

Stripes: a prefix word keys a counter of what follows it, (next word, word after that) -> occurrences, with an empty
word where the piece of text ends. One structure gives everything: the sum of a stripe is the prefix's own
frequency, the sums by next word are those of two-word phrases, its entries are those of three words, and the largest
entries tell which shorter phrases a longer one subsumes.

1. A task counts its rows in arrays and writes one stripe for each (language, prefix) and chunk of about `CHUNK` words.
2. Stripes of one prefix meet in one task, sorted, and are merged elementwise as they stream by; what a task holds is one
   merged stripe. Prefixes with more than a quarter of a partition's share of a sample of rows are split by a hash of what
   follows, in proportion to their share: a sub-stripe stays bounded as the session's number of partitions grows. The
   sample only steers this; all counts are over all rows.
3. Of whole stripes only phrases that occur often enough leave the task; of split ones also the parts of sums.
4. Joins of these few phrases give the parts' frequencies; scores are decimals of 38 digits, exact for phrases that
   occur less than 10^16 times. The first rows of a language are limited in each task before they meet.

Words are lower-cased in A-Z. Null and empty texts have no words, a null language is `und`. Repeated rows count each.
Ties go by frequency, then by phrase. Very long texts are counted whole; a chunk may grow by one text. An empty table
gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.ranking import salted_join, top_n
from corpuslens.llm.common import ragged, slices, stage, width

#: Words of a chunk; entries that are merged at a time.
CHUNK, MERGED = 1_500_000, 400_000
#: Share of the rows that tells which prefixes are split.
SAMPLED = 0.01
NO_LANGUAGE = "und"
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
#: A stripe's entries are lines `x y n`: a third of the bytes of arrays. Words hold neither blanks nor line ends.
STRIPE = "lang string, w string, slot int, entries string"
COUNT = "lang string, w string, x string, y string, n bigint"


class Chunk:
    """The words of some texts as numbers, by language; number 0 is the end of a piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {b"": 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.words = 0

    def add(self, lang: str, text: str) -> None:
        numbers, out = self.numbers, [0]
        for piece in text.encode("utf-8").lower().translate(BREAKS).split(b"\n"):  # bytes: A-Z only
            if words := piece.split():
                out += [numbers.setdefault(w, len(numbers)) for w in words]
                out.append(0)
        if len(out) > 1:
            self.parts.setdefault(lang, []).append(np.array(out[1:], np.int64))
            self.words += len(out)

    def counts(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """w, x, y, n of every (word, next, the one after), sorted by w, x, y."""
        at = np.concatenate([*parts, [0, 0]])
        w, x, y = at[:-2], at[1:-1], at[2:]
        base = len(self.numbers)
        starts = w > 0
        w, x = w[starts], x[starts]
        y = np.where(x > 0, y[starts], 0)
        if base < 1 << 21:
            key, n = np.unique((w * base + x) * base + y, return_counts=True)
            return key // base // base, key // base % base, key % base, n
        pair, number = np.unique(w * base + x, return_inverse=True)
        key, n = np.unique(number * base + y, return_counts=True)
        pair = pair[key // base]
        return pair // base, pair % base, key % base, n

    def stripes(self, splits: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        strings = pa.array([w.decode("utf-8") for w in self.numbers], pa.string())
        for lang, parts in self.parts.items():
            w, x, y, n = self.counts(parts)
            slots = np.zeros(len(w), np.int64)
            split = {self.numbers[word]: k for word, k in splits.get(lang, {}).items() if word in self.numbers}
            if split:
                ways = np.ones(len(strings), np.int64)
                ways[list(split)] = list(split.values())
                sums = np.fromiter(map(zlib.crc32, self.numbers), np.int64, len(strings))
                slots = np.where(ways[w] > 1, (sums[x] * 31 + sums[y]) % ways[w], 0)
                order = np.lexsort((slots, w))
                w, x, y, n, slots = w[order], x[order], y[order], n[order], slots[order]
            starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (slots[1:] != slots[:-1])])
            ends = np.r_[starts[1:], len(w)]
            for i in range(0, len(starts), 4096):
                s, e = starts[i : i + 4096], ends[i : i + 4096]
                part = slice(s[0], e[-1])
                lines = pc.binary_join_element_wise(
                    strings.take(pa.array(x[part])), strings.take(pa.array(y[part])), pc.cast(pa.array(n[part]), pa.string()), " ")
                lists = pa.ListArray.from_arrays(pa.array((np.r_[s, e[-1]] - s[0]).astype(np.int32)), lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(s), pa.string()), strings.take(pa.array(w[s])), pa.array(slots[s].astype(np.int32)),
                     pc.binary_join(lists, "\n")], names=["lang", "w", "slot", "entries"])


def frequent_prefixes(texts: DataFrame, sampled: float = SAMPLED) -> dict[str, dict[bytes, int]]:
    """{language: {word: parts}} of the words whose stripes are split, after a sample of rows (lang, text).

    A word with the share s of the sampled words gets s times four times the number of shuffle partitions parts, so at
    most that number of words are collected.
    """
    parts = 4 * width(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = Chunk()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk.add(lang, text)
            words = [w.decode("utf-8") for w in chunk.numbers]
            for lang, held in chunk.parts.items():
                n = np.bincount(np.concatenate(held), minlength=len(words))
                at = np.flatnonzero(n[1:]) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([words[i] for i in at], pa.string()), pa.array(n[at])],
                    names=["lang", "w", "n"])

    counted = stage(texts.sample(sampled, seed=1).mapInArrow(run, "lang string, w string, n bigint").groupBy("lang", "w").agg(
        F.sum("n").alias("n")), "sampled-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    out: dict[str, dict[bytes, int]] = {}
    for r in counted.where(F.col("n") * parts >= 2 * total).collect():
        out.setdefault(r["lang"], {})[r["w"].encode()] = -(-r["n"] * parts // total)
    return out


def stripes(texts: DataFrame, splits: dict[str, dict[bytes, int]], chunk_words: int = CHUNK) -> DataFrame:
    """lang, w, slot, entries: the stripes of each chunk of rows (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in batches:
            for part in slices(batch, 64):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    chunk.add(lang, text)
                    if chunk.words >= chunk_words:
                        yield from chunk.stripes(splits)
                        chunk = Chunk()
        yield from chunk.stripes(splits)

    return texts.mapInArrow(run, STRIPE)


def merged_counts(striped: DataFrame, splits: dict[str, dict[bytes, int]], least: int) -> DataFrame:
    """lang, w, x, y, n: frequencies of prefixes (x and y null), of two words (y null) and of three, from `least` on.

    Rows without w hold the number of all words. Prefixes that are split give parts of sums, which are added up.
    """
    keys = ["lang", "w", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(batch: pa.RecordBatch) -> pa.Table:
            lists = pc.split_pattern(batch.column("entries"), "\n")
            lines = lists.flatten()
            source = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())))
            fields = pc.split_pattern(lines, " ").flatten()
            x, y, n = (fields.take(pa.array(np.arange(k, 3 * len(lines), 3))) for k in range(3))
            return pa.table([batch.column(c).take(source) for c in keys] + [x, y, pc.cast(n, pa.int64())], names=[*keys, "x", "y", "n"])

        def merged(held: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(held).group_by([*keys, "x", "y"]).aggregate([("n", "sum")]).rename_columns([*keys, "x", "y", "n"])

        def outcome(table: pa.Table) -> Iterator[pa.RecordBatch]:
            def rows(lang, w, x, y, n, whole=None):
                n_ = n.to_numpy()
                keep = np.ones(len(n_), bool) if whole is None else (n_ >= least) | ~whole
                keep = pa.array(np.flatnonzero(keep))
                none = pa.nulls(len(n_), pa.string())
                yield from pa.table([(none if c is None else c).take(keep) for c in (lang, w, x, y)] + [n.take(keep)],
                                    names=["lang", "w", "x", "y", "n"]).to_batches(max_chunksize=10_000)

            def whole(table: pa.Table) -> np.ndarray:
                return np.array([splits.get(lang, {}).get(w.encode(), 1) == 1 for lang, w in zip(
                    table.column("lang").to_pylist(), table.column("w").to_pylist())], bool) if splits else np.ones(table.num_rows, bool)

            # entries of a split stripe are whole as well: a triple is in one part only
            three = table.filter(pc.and_(pc.not_equal(table.column("y"), ""), pc.greater_equal(table.column("n"), least)))
            yield from rows(three.column("lang"), three.column("w"), three.column("x"), three.column("y"), three.column("n"))
            two = table.group_by(["lang", "w", "x"]).aggregate([("n", "sum")])
            one = two.group_by(["lang", "w"]).aggregate([("n_sum", "sum")])
            all_ = one.group_by(["lang"]).aggregate([("n_sum_sum", "sum")])
            two = two.filter(pc.not_equal(two.column("x"), ""))
            yield from rows(two.column("lang"), two.column("w"), two.column("x"), None, two.column("n_sum"), whole(two))
            yield from rows(one.column("lang"), one.column("w"), None, None, one.column("n_sum_sum"), whole(one))
            yield from rows(all_.column("lang"), None, None, None, all_.column("n_sum_sum_sum"))

        held: list[pa.Table] = []
        size, bound = 0, MERGED
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(flat(batch))
            size += held[-1].num_rows
            if size < bound:
                continue
            table = merged(held)
            # the last key's stripe may go on in the next batch
            last = [table.column(c) for c in keys]
            final = [batch.column(c)[-1] for c in keys]
            goes_on = pc.and_(pc.and_(pc.equal(last[0], final[0]), pc.equal(last[1], final[1])),
                                      pc.equal(last[2], final[2]))
            yield from outcome(table.filter(pc.invert(goes_on)))
            held = [table.filter(goes_on)]
            size = held[0].num_rows
            bound = max(MERGED, 2 * size)
        if held:
            yield from outcome(merged(held))

    met = striped.repartition(*keys).sortWithinPartitions(*keys)
    counts = met.mapInArrow(run, COUNT).groupBy("lang", "w", "x", "y").agg(F.sum("n").alias("n"))
    return counts.where(F.col("w").isNull() | (F.col("n") >= least))


def score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 a a / (left right)), exact."""
    return F.expr(f"cast(cast(1000000 as decimal(7,0)) * (cast({a} as decimal(16,0)) * cast({a} as decimal(16,0))) "
                  f"div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0))) as bigint)")


def collocations(
    df: DataFrame, least: int = 10, subsumed: int = 50, first: int | None = 2000, lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language; all of them where `first` is None.

    Phrases occur at least `least` times; one is left out if a longer one that holds it has at least `subsumed` per cent
    of its occurrences.
    """
    texts = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_column).alias("text")).where(
        F.col("text").isNotNull())
    splits = frequent_prefixes(texts)
    counts = stage(merged_counts(stripes(texts, splits), splits, least), "phrase-counts")
    words = counts.where("w IS NULL").select("lang", F.col("n").alias("words"))
    one = counts.where("w IS NOT NULL AND x IS NULL").select("lang", "w", "n")
    two = counts.where("x IS NOT NULL AND y IS NULL").select("lang", "w", "x", F.col("n").alias("a"))
    three = counts.where("y IS NOT NULL").select("lang", "w", "x", "y", F.col("n").alias("a"))

    def with_word(rows: DataFrame, word: str, name: str) -> DataFrame:
        return salted_join(rows, one.select("lang", F.col("w").alias(word), F.col("n").alias(name)), ["lang", word], "a", salts=8)

    def with_pair(rows: DataFrame, first_word: str, second_word: str, name: str) -> DataFrame:
        return rows.join(two.select("lang", F.col("w").alias(first_word), F.col("x").alias(second_word), F.col("a").alias(name)),
                         ["lang", first_word, second_word])

    right = three.groupBy("lang", "w", "x").agg(F.max("a").alias("longer"))
    left = three.groupBy("lang", F.col("x").alias("w"), F.col("y").alias("x")).agg(F.max("a").alias("longer"))
    longest = right.unionByName(left).groupBy("lang", "w", "x").agg(F.max("longer").alias("longer"))
    pairs = two.join(longest, ["lang", "w", "x"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    pairs = with_word(with_word(pairs, "w", "l"), "x", "r").select(
        "lang", F.concat_ws(" ", "w", "x").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score"))
    triples = with_pair(with_pair(with_word(with_word(three, "w", "l1"), "y", "r2"), "w", "x", "l2"), "x", "y", "r1").select(
        "lang", F.concat_ws(" ", "w", "x", "y").alias("phrase"), "a", "l1", "r1", "l2", "r2",
        score("a", "l1", "r1").alias("s1"), score("a", "l2", "r2").alias("s2"))
    cut = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", F.when(cut, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(cut, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    found = pairs.unionByName(triples)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_n(found, ["lang"], order, first if first is not None else 1 << 30).withColumn("rank", F.col("rank").cast("long"))
    # one row a language
    totals = words.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
