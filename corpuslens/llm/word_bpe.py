"""Byte-pair encoding with word ends: batched numpy merge rounds, and decoding.

A text is cut at white space into chunks; chunks that were not seen before are normalised, cut into words,
and all their words are merged together: the symbols of all words stand in one flat array, each round finds
the rank of every adjacent pair by binary search over the sorted pair keys, and merges in every word the pair
of the lowest rank. The results of chunks are remembered up to a fixed number of them and of their characters.

Nulls count as empty texts; empty texts have no ids and decode to an empty text. Very long texts and words
need memory in proportion to themselves only. Repeated rows are encoded row by row.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpuslens.llm.common import own_memory, ragged, slices, texts

#: Chunks remembered by a worker at most; beyond that it starts anew.
REMEMBERED = 500_000
#: Characters of the chunks remembered at most; a slice of texts may go beyond it once.
REMEMBERED_CHARS = 16_000_000
NO_RANK = np.iinfo(np.int64).max
#: str.split() cuts at these too, the tokenizer's white space class does not hold them.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Lists:
    """Lists of numbers in one growing array."""

    def __init__(self, kind):
        self.starts, self.lengths, self.values = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, kind)
        self.count = self.used = 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        total, used = self.count + len(lengths), self.used + len(values)
        if total > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * total), np.resize(self.lengths, 2 * total)
        if used > len(self.values):
            self.values = np.resize(self.values, 2 * used)
        self.starts[self.count : total] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : total] = lengths
        self.values[self.used : used] = values
        self.count, self.used = total, used


class WordBpe:
    """Encoder and decoder of a vocabulary file with word-end symbols."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.splitter = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in self.special))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # all places of the lowest pair may be merged at once if no symbol is used by a pair ranked before it is made
        first_use = np.full(self.base, NO_RANK)
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        born = np.full(self.base, -1)
        born[made[::-1]] = np.arange(len(merges))[::-1]
        if (first_use[made] <= born[made]).any():
            raise ValueError("a pair is ranked before its parts are made")
        self.tokens = np.empty(self.base, object)
        self.tokens[:] = ""
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.remembered = remembered
        self.small = np.uint16 if self.base <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known, self.words_known = Numbers(), Numbers()
        self.chunk_ids, self.word_ids = Lists(self.small), Lists(self.small)
        self.chars = 0

    # --- merging ------------------------------------------------------------------------------------
    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []

        def pair_at(i: np.ndarray) -> np.ndarray:
            """Places in the table of the pairs that start at i; -1: none."""
            keys = symbols[i] * self.base + symbols[i + 1]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            return np.where((word[i] == word[i + 1]) & (self.keys[at] == keys), at, -1)

        known = np.full(len(symbols), -1)
        known[:-1] = pair_at(np.arange(len(symbols) - 1))
        while len(symbols):
            pair = np.flatnonzero(known >= 0)
            if not len(pair):
                break
            at = known[pair]
            rank, owner = self.rank[at], word[pair]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            active = owner[first]
            hit = rank == np.repeat(lowest, np.diff(np.r_[first, len(owner)]))
            pair, at = pair[hit], at[hit]
            # of places that overlap, every other one counts, from the left
            new_run = np.r_[True, np.diff(pair) != 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(pair)), 0))
            chosen = (np.arange(len(pair)) - run_start) % 2 == 0
            pair, at = pair[chosen], at[chosen]
            symbols[pair] = self.made[at]
            keep = np.ones(len(symbols), bool)
            keep[pair + 1] = False
            # words without any pair to merge are done
            alive = np.zeros(len(lengths), bool)
            alive[active] = True
            living = alive[word]
            done = keep & ~living
            done_symbols.append(symbols[done])
            done_words.append(word[done])
            keep &= living
            merged = (np.cumsum(keep) - 1)[pair]
            symbols, word, known = symbols[keep], word[keep], known[keep]
            # only the pairs around a merged symbol are new
            known[merged] = -1
            stale = np.concatenate([merged - 1, merged])
            stale = stale[(stale >= 0) & (stale < len(symbols) - 1)]
            known[stale] = pair_at(stale)
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    # --- chunks -------------------------------------------------------------------------------------
    def _unusual(self, chunk: str) -> list[str]:
        """Words of a chunk with code points that this Python's Unicode version may not know."""
        if self.splitter is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.splitter = (Tokenizer.from_file(self.path).normalizer,
                             pre_tokenizers.Split(Regex(self.words.pattern), "removed", invert=True))
        normalizer, split = self.splitter
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(chunk))]

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words of a chunk, and ids of special tokens."""
        if self.special and "<|" in chunk:
            found = list(self.special_pattern.finditer(chunk))
            if found:
                out, at = [], 0
                for m in found:
                    out += [*self._pieces(chunk[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                return out + self._pieces(chunk[at:])
        if chunk.isascii():
            chunk = chunk.lower()
        elif not chunk.isprintable():
            return self._unusual(chunk)
        else:  # lower case by character: a final sigma is none of its own
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        self.chars += sum(map(len, chunks))
        words, before = self.words_known, len(self.words_known)
        plan: list[int] = []  # a word's number, or -1 - id of a special token
        sizes = []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                plan.append(words[chunk.lower()])
                sizes.append(1)
                continue
            pieces = self._pieces(chunk)
            sizes.append(len(pieces))
            plan += [words[p] if p.__class__ is str else -1 - p for p in pieces]
        if len(words) > before:
            self.word_ids.add(*self.merge_words([w.encode("utf-8") for w in islice(words, before, None)]))
        order = np.array(plan, np.int64)
        is_word = order >= 0
        source, length = np.zeros(len(order), np.int64), np.ones(len(order), np.int64)
        source[is_word], length[is_word] = self.word_ids.starts[order[is_word]], self.word_ids.lengths[order[is_word]]
        flat = self.word_ids.values[ragged(source, length)]
        at = np.cumsum(length) - length
        flat[at[~is_word]] = -1 - order[~is_word]
        owner = np.repeat(np.arange(len(chunks)), sizes)
        self.chunk_ids.add(flat, np.bincount(owner, weights=length, minlength=len(chunks)).astype(np.int64))

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if len(self.known) > self.remembered or self.chars > REMEMBERED_CHARS:
            self._forget()
        known, before = self.known, len(self.known)
        if any(map(NOT_SPACE.search, batch)):
            lists = pa.array([[c for c in SPACE.split(t) if c] for t in batch], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(pa.array(batch, pa.string()))
        # Python meets each distinct chunk of the batch once
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        ends = lists.offsets.to_numpy()
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            at = numbers[start:end]
            yield self.chunk_ids.values[ragged(self.chunk_ids.starts[at], self.chunk_ids.lengths[at])].astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with a space between them, as the file names no decoder."""
        return " ".join(self.tokens[ids].tolist())


@lru_cache(maxsize=2)
def _codec(path: str) -> WordBpe:
    return WordBpe(path)


def _forget_codecs() -> None:
    _codec.cache_clear()


def codec(path: str) -> WordBpe:
    """One codec a worker process: its remembered chunks serve the tasks that follow."""
    own_memory(_forget_codecs)
    return _codec(path)


def encode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (array of long): the ids of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids = list(bpe.encode(texts(part.column(1))))
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, ids array<bigint>")


def decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id, text: the decoded text of every array of ids; null arrays decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                out = [bpe.decode(np.array(i or [], np.int64)) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[id_column, "text"])

    rows = df.select(id_column, ids_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every text, keeps digests only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for part in slices(batch):
                n, ids_hash, text_hash = [], [], []
                for ids in bpe.encode(texts(part.column(1))):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                    names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
