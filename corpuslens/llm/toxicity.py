"""Toxic spans by a linear-chain conditional random field.

Each word of a text is clean or toxic. A word's own weight comes from its features (itself, how it begins and
ends), neighbours are tied by transition weights; the forward-backward algorithm gives each word's marginal
probability. The tokens' labels for the fit are derived from the documents' labels: in a clean document no word
is toxic; in a toxic one, those are whose features stand in toxic documents far more often than in clean ones, or
else the most suspicious one; after a first fit its own marginals label the words of toxic documents anew. A
document's score is a logistic function of its expected number of toxic words and of its highest marginal; words
with a marginal of one half or more are the offending spans, in code points.

The fit uses at most `per_class` labelled rows of each class outside the held-out fold (see `labelled_sample`);
every text is tagged whole. Long texts are tagged in segments with `CONTEXT` words more on both sides: transition
weights are bounded so that what lies further away changes a marginal by less than a millionth. Null and empty
texts have no words and the lowest score. Repeated rows score alike. If a class has no labelled rows the score is
the other class's label, 0.5 without any; `keep` then passes all rows, as there is no evidence against any. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out, labelled_sample, logistic, own_memory, ragged, slices, texts

PER_CLASS = 1000
MAX_CHARS = 32_768
SEGMENT = 192
CONTEXT = 48
#: Bound on the log odds ratio of the transitions.
MOST_TIED = 3.0
#: Words remembered by a worker at most, and the longest that it remembers.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: A feature must stand in so many labelled documents.
LEAST_DOCUMENTS = 4
THRESHOLD = 0.5
#: Standard errors that evidence is lowered by, and what it must reach for a word to count as toxic at first.
DOUBT = 1.5
EVIDENCE = 1.4
RIDGE = 0.2
WORD = re.compile(r"\w+")


def lower_words(text: str) -> list[str]:
    """The words, matched before they are lower-cased: a lower-cased text may be longer than the text."""
    return [w.lower() for w in WORD.findall(text)] if not text.isascii() else WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word itself, and longer words by their first 4 to 8 and last 4 to 6 letters."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in range(4, min(9, n))), *("$" + word[-k:] for k in range(4, min(7, n)))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    #: log of the transition weights clean-toxic, toxic-clean and toxic-toxic (clean-clean: 0), and of a toxic start
    ties: tuple[float, float, float]
    start: float
    document: tuple[float, ...]
    constant: float | None = None


class Segments:
    """Texts of different lengths as rows of equal length: a core of SEGMENT words and its context."""

    def __init__(self, lengths: np.ndarray):
        begins = np.cumsum(lengths) - lengths
        pieces = -(-lengths // SEGMENT)
        core = ragged(np.zeros(len(lengths)), pieces) * SEGMENT
        base, n = np.repeat(begins, pieces), np.repeat(lengths, pieces)
        left = np.maximum(core - CONTEXT, 0)
        self.first = base + left
        self.length = np.minimum(core + SEGMENT + CONTEXT, n) - left
        self.core_at = core - left
        self.core_length = np.minimum(SEGMENT, n - core)
        self.at_start = left == 0
        order = np.argsort(-self.length, kind="stable")
        for name in ("first", "length", "core_at", "core_length", "at_start"):
            setattr(self, name, getattr(self, name)[order])

    def active(self, t: int) -> int:
        """Rows longer than t; they come first."""
        return int(np.searchsorted(-self.length, -t, side="left"))

    def put(self, flat: np.ndarray) -> np.ndarray:
        """Position-major matrix of what belongs to each row, zero beyond its end."""
        out = np.zeros((int(self.length[0]) if len(self.length) else 0, len(self.length)))
        row = np.repeat(np.arange(len(self.length)), self.length)
        column = ragged(np.zeros(len(self.length)), self.length)
        out[column, row] = flat[ragged(self.first, self.length)]
        return out

    def take(self, matrix: np.ndarray, total: int) -> np.ndarray:
        out = np.zeros(total)
        row = np.repeat(np.arange(len(self.length)), self.core_length)
        column = ragged(self.core_at, self.core_length)
        out[ragged(self.first + self.core_at, self.core_length)] = matrix[column, row]
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, ties: tuple[float, float, float], start: float, pairs: bool = False):
    """Marginals of the toxic state; with `pairs`, also the expected counts of the three weighted transitions.

    With two states each message is one number, the odds of the toxic state.
    """
    seg = Segments(lengths)
    e = np.exp(np.clip(seg.put(emission), -30, 30))
    to_toxic, to_clean, stay = np.exp(ties)
    steps, rows = e.shape
    ahead, behind = np.zeros((steps, rows)), np.ones((steps, rows))
    if steps:
        ahead[0] = e[0] * np.where(seg.at_start, np.exp(start), to_toxic)
    for t in range(1, steps):
        k = seg.active(t)
        r = ahead[t - 1, :k]
        ahead[t, :k] = e[t, :k] * (to_toxic + stay * r) / (1 + to_clean * r)
    for t in range(steps - 2, -1, -1):
        k = seg.active(t + 1)
        s = e[t + 1, :k] * behind[t + 1, :k]
        behind[t, :k] = (to_clean + stay * s) / (1 + to_toxic * s)
    odds = ahead * behind
    marginals = seg.take(odds / (1 + odds), len(emission))
    if not pairs:
        return marginals
    counts = np.zeros(3)
    for t in range(1, steps):
        k = seg.active(t)
        # within the core only, so that each pair counts once
        inside = (t >= seg.core_at[:k] + (seg.core_at[:k] == 0)) & (t < seg.core_at[:k] + seg.core_length[:k])
        r, s = ahead[t - 1, :k], e[t, :k] * behind[t, :k]
        parts = np.stack([to_toxic * s, to_clean * r, stay * r * s])
        counts += (parts / (1 + parts.sum(0)))[:, inside].sum(1)
    return marginals, counts


class Fit:
    """The sample's distinct words as rows of features."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        numbers: dict[str, int] = {}
        tokens, self.lengths = [], []
        for _, _, text in rows:
            found = lower_words(text)
            tokens += [numbers.setdefault(w, len(numbers)) for w in found]
            self.lengths.append(len(found))
        self.lengths, self.tokens = np.array(self.lengths, np.int64), np.array(tokens, np.int64)
        self.doc = np.repeat(np.arange(len(rows)), self.lengths)
        self.y = np.array([y for _, y, _ in rows])
        # a feature counts once a document
        seen = np.unique(self.doc * len(numbers) + self.tokens) if len(self.tokens) else np.zeros(0, np.int64)
        names: dict[str, int] = {}
        owner, feature = [], []
        for word, i in numbers.items():
            for f in features(word):
                owner.append(i)
                feature.append(names.setdefault(f, len(names)))
        owner, feature = np.array(owner, np.int64), np.array(feature, np.int64)
        per_word = np.bincount(owner, minlength=len(numbers))
        begins = np.cumsum(per_word) - per_word
        word, document = seen % max(1, len(numbers)), seen // max(1, len(numbers))
        pairs = np.unique(np.repeat(document, per_word[word]) * len(names) + feature[ragged(begins[word], per_word[word])])
        toxic = self.y[pairs // max(1, len(names))] == 1
        at = pairs % max(1, len(names))
        in_toxic = np.bincount(at[toxic], minlength=len(names))
        in_clean = np.bincount(at[~toxic], minlength=len(names))
        kept = in_toxic + in_clean >= LEAST_DOCUMENTS
        n1, n0 = max(1, int((self.y == 1).sum())), max(1, int((self.y == 0).sum()))
        odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_clean + 0.5) / (n0 + 1))
        # sure only with some documents behind it
        doubt = np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5))
        self.names = [f for f, k in zip(names, kept) if k]
        renumber = np.cumsum(kept) - 1
        use = kept[feature]
        self.owner, self.feature = owner[use], renumber[feature[use]]
        self.evidence = np.full(len(numbers), -9.0)
        np.maximum.at(self.evidence, self.owner, (odds - DOUBT * doubt)[kept][self.feature])
        self.words = len(numbers)

    def labels(self, suspicion: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Toxic words of toxic documents; and the words that the fit uses: a toxic document without any is left out."""
        toxic = (self.y[self.doc] == 1) & (suspicion >= least)
        has = np.bincount(self.doc[toxic], minlength=len(self.y)) > 0
        return toxic, (self.y[self.doc] == 0) | has[self.doc]

    def train(self, z: np.ndarray, used: np.ndarray, rounds: int, w=None, ties=(-4.0, 0.0, -4.0), start=-4.0, ridge: float = RIDGE):
        """Gradient ascent on the conditional log-likelihood, with AdaGrad steps."""
        w = np.zeros(len(self.names)) if w is None else w
        other = np.array([*ties, start])
        tokens, doc, z = self.tokens[used], self.doc[used], z[used].astype(float)
        lengths = np.bincount(doc, minlength=len(self.lengths))
        before = doc[1:] == doc[:-1]
        given = np.array([(before & (z[:-1] == 0) & (z[1:] == 1)).sum(), (before & (z[:-1] == 1) & (z[1:] == 0)).sum(),
                          (before & (z[:-1] == 1) & (z[1:] == 1)).sum()], float)
        first = np.flatnonzero(np.r_[True, ~before]) if len(doc) else np.zeros(0, np.int64)
        squares, other_squares = np.full(len(w), 1e-8), np.full(4, 1e-8)
        for _ in range(rounds):
            e = np.bincount(self.owner, weights=w[self.feature], minlength=self.words)[tokens]
            p, expected = forward_backward(e, lengths, tuple(other[:3]), other[3], pairs=True)
            per_word = np.bincount(tokens, weights=z - p, minlength=self.words)
            g = np.bincount(self.feature, weights=per_word[self.owner], minlength=len(w)) - ridge * w
            squares += g * g
            w = w + 0.5 * g / np.sqrt(squares)
            h = np.r_[given - expected, (z - p)[first].sum()] - ridge * other
            other_squares += h * h
            other = other + 0.2 * h / np.sqrt(other_squares)
            tied = other[2] - other[0] - other[1]
            other[2] -= np.sign(tied) * max(0.0, abs(tied) - MOST_TIED)
        return w, tuple(other[:3].tolist()), float(other[3])


def document_features(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log of the expected number of toxic words, and the highest marginal's log odds, of each text."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(doc, weights=marginals, minlength=len(lengths))
    most = np.zeros(len(lengths))
    np.maximum.at(most, doc, marginals)
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.log(total + 1e-2), np.log(most / (1 - most))], 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS,
        id_column: str = "doc_id", text_column: str = "text", rounds: int = 40) -> Model:
    rows = labelled_sample(docs, labels, label, per_class, max_chars, id_column, text_column)
    return fit_rows(rows, rounds)


def fit_rows(rows: list[tuple[int, int, str]], rounds: int = 40) -> Model:
    found = {y for _, y, _ in rows}
    if len(found) < 2:
        return Model({}, (0.0, 0.0, 0.0), 0.0, (), float(found.pop()) if found else 0.5)
    # two thirds fit the field, the rest the documents' scores
    order = np.random.default_rng(1).permutation(len(rows))
    cut = max(1, 2 * len(rows) // 3)
    sample = Fit([rows[i] for i in order[:cut]])
    emission = lambda w: np.bincount(sample.owner, weights=w[sample.feature], minlength=sample.words)[sample.tokens]
    w, ties, start = sample.train(*sample.labels(sample.evidence[sample.tokens], EVIDENCE), rounds)
    p = forward_backward(emission(w), sample.lengths, ties, start)
    w, ties, start = sample.train(*sample.labels(p, 0.5), rounds // 2, w, ties, start)
    model = Model({f: round(float(v), 4) for f, v in zip(sample.names, w) if abs(v) >= 0.02}, ties, start, ())
    fresh = [rows[i] for i in order[cut:]] or rows
    if len({y for _, y, _ in fresh}) < 2:
        fresh = rows
    marginals, lengths = tag(model, [t for _, _, t in fresh])
    _remembered.clear()
    weights = logistic(document_features(marginals, lengths), np.array([float(y) for _, y, _ in fresh]), 1e-2)
    return Model(model.weights, ties, start, tuple(weights.tolist()))


#: The last model of this process and the weights of words under it.
_remembered: list[tuple[Model, dict[str, float]]] = []


def _forget_words() -> None:
    _remembered.clear()


def tag(model: Model, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of all texts, and the number of words of each text."""
    if not _remembered or _remembered[0][0] is not model or len(_remembered[0][1]) > REMEMBERED:
        _remembered[:] = [(model, {})]
    known = _remembered[0][1]
    lengths, values = [], []
    get, weight = known.get, model.weights.get
    for text in batch:
        words = lower_words(text)
        lengths.append(len(words))
        for w in words:
            v = get(w)
            if v is None:
                v = sum(weight(f, 0.0) for f in features(w))
                if len(w) <= LONGEST_REMEMBERED:
                    known[w] = v
            values.append(v)
    lengths = np.array(lengths, np.int64)
    return forward_backward(np.array(values), lengths, model.ties, model.start), lengths


def score_texts(model: Model, batch: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and offending spans of each text."""
    if model.constant is not None:
        return np.full(len(batch), model.constant), [[] for _ in batch]
    marginals, lengths = tag(model, batch)
    x = np.c_[np.ones(len(batch)), document_features(marginals, lengths)]
    scores = 1 / (1 + np.exp(-np.clip(x @ np.array(model.document), -30, 30)))
    spans = []
    begins = np.cumsum(lengths) - lengths
    for i, text in enumerate(batch):
        own = marginals[begins[i] : begins[i] + lengths[i]]
        at = np.flatnonzero(own >= 0.5)
        places = [m.span() for m in WORD.finditer(text)] if len(at) else []
        spans.append([{"start": places[k][0], "end": places[k][1], "p": float(own[k])} for k in at.tolist()])
    return scores, spans


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, predicted, spans (start, end, p) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory(_forget_words)
        for batch in batches:
            for part in slices(batch):
                s, spans = score_texts(shared.value, texts(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, kind)],
                    names=[id_column, "score", "predicted", "spans"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"{id_column} {rows.schema[id_column].dataType.simpleString()}, score double, predicted int, "
                                "spans array<struct<start:int,end:int,p:double>>")


def keep(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted toxic; all rows unless the model has seen both labels."""
    if model.constant is not None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory(_forget_words)
        for batch in batches:
            for part in slices(batch):
                s, _ = score_texts(shared.value, texts(part.column(at)))
                yield part.filter(pa.array(s < threshold))

    return df.mapInArrow(run, df.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document; fitted on the labels outside the held-out fold."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
