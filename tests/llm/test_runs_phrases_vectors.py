"""Periodic runs, collocations and vector packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuslens.llm import collocations, runs, vector_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- runs -------------------------------------------------------------------------------------------
def brute_runs(w, least=24, times=3):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                out.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = (None,) * 4
    for s, length, q in found:  # by start, then period
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in found)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(kept)))


def random_words(r):
    k, n = r.choice([1, 2, 2, 3, 5]), r.choice([0, 1, 23, 24, 30, 60, 120, 250])
    w = [r.randrange(k) for _ in range(n)]
    if n and r.random() < 0.7:
        p, a = r.randint(1, max(1, n // 3)), r.randrange(n)
        w = w[:a] + [w[a + i % p] if a + i % p < n else 9 for i in range(n - a)]
    if r.random() < 0.3:
        w = w + w + w[: r.randint(0, len(w))]
    return w


def test_runs_equal_brute_force():
    r = random.Random(1)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    docs = [random_words(r) for _ in range(400)] + [fibonacci[1], fibonacci[1] * 3, [0] * 1000, [], [1], [0, 1] * 12, [0, 1] * 12 + [0]]
    found = runs.find_runs([np.array(d, np.int64) for d in docs])
    assert sum(map(len, found)) > 200
    for d, f in zip(docs, found):
        assert list(map(tuple, f.tolist())) == brute_runs(d), d


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.integers(1, 6), st.lists(st.integers(0, 1), max_size=10))
def test_repeated_words_are_found(unit, times, tail):
    d = unit * times + tail
    assert list(map(tuple, runs.find_runs([np.array(d, np.int64)])[0].tolist())) == brute_runs(d)


def test_documents_do_not_change_each_other():
    r = random.Random(2)
    docs = [np.array(random_words(r), np.int64) for _ in range(60)]
    together = runs.find_runs(docs + docs[::-1])
    for d, a, b in zip(docs, together, together[::-1]):
        assert a.tolist() == b.tolist() == runs.find_runs([d])[0].tolist()


def test_tested_in_parts(monkeypatch):
    r = random.Random(3)
    docs = [np.array(random_words(r), np.int64) for _ in range(80)]
    whole = runs.find_runs(docs)
    monkeypatch.setattr(runs, "TESTED", 50)
    assert [f.tolist() for f in whole] == [f.tolist() for f in runs.find_runs(docs)]


def test_a_long_run_takes_time_in_proportion():
    found = runs.find_runs([np.tile(np.arange(7), 60_000)])
    assert found[0].tolist() == [[0, 420_000, 7]]


def run_rows():
    r = random.Random(4)
    words = ["a", "B", "é", "日本", "x."]
    rows = [(i, " \t\n\x0b".join(["", *(words[k % len(words)] for k in random_words(r))])) for i in range(250)]
    rows += [(i, "a b   c\x1cd " * 40) for i in (300, 301)]
    return rows + [(None, "a " * 50), (None, None), (7, None), (7, "b " * 40), (8, ""), (8, ""), (9, "z" * 200_000), (10, "q r " * 5000)]


def test_run_digests_equal_brute_force(spark):
    rows = run_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_runs int, period string")
    got = sorted(map(tuple, runs.run_digests(df).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_runs_and_collapsed_texts_as_tables(spark):
    df = spark.createDataFrame([("k", "one " + "la le " * 20 + "end"), (None, None)], "key string, body string")
    assert [tuple(r) for r in runs.periodic_runs(df, "key", "body").collect()] == [("k", 1, 40, 2)]
    assert sorted(map(tuple, runs.collapse(df, "key", "body").collect()), key=str) == [("k", "one la le end"), (None, "")]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert runs.run_digests(empty).collect() == [] and runs.periodic_runs(empty).collect() == []


# --- collocations -----------------------------------------------------------------------------------
def brute_phrases(rows, least=10, first=2000):
    f = defaultdict(Counter)
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in chosen.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in chosen.items()):
                continue
            s, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_rows(seed, n=400):
    r = random.Random(seed)
    words = ["The", "of", "a", "é", "Éa", "x y", "日本", "b", "c", "d"]
    def text():
        return "".join(r.choice(words[: r.choice([2, 4, 10])]) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\x0b"]) for _ in range(r.choice([0, 1, 5, 60])))
    return [(r.choice(["en", "en", "de", None, ""]), text()) for _ in range(n)] + [("en", None), ("fr", ""), ("fr", " .,"), ("xx", "a " * 3000)]


@pytest.mark.parametrize("first", [2000, 7, None])
def test_collocations_equal_brute_force(spark, first):
    rows = phrase_rows(5)
    df = spark.createDataFrame([(lang, text, 1, "w") for lang, text in rows], "lang string, text string, n int, w string")
    got = sorted(map(tuple, collocations.collocations(df, first=first).collect()))
    assert got == brute_phrases(rows, first=first or 10**9) and len(got) > 20


def test_split_stripes_and_small_chunks_change_nothing(spark, monkeypatch):
    rows = phrase_rows(6)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "MERGED", 40)
    monkeypatch.setattr(collocations, "frequent_prefixes", lambda texts: {"en": {b"the": 5, b"of": 3}, "xx": {b"a": 4}, "zz": {b"q": 2}})
    plain = collocations.stripes
    monkeypatch.setattr(collocations, "stripes", lambda texts, splits: plain(texts, splits, 150))
    assert sorted(map(tuple, collocations.collocations(df).collect())) == brute_phrases(rows)


def test_frequent_prefixes_follow_the_share(spark):
    rows = [("en", "the cat the dog the cow the " + " ".join(f"w{i}x{k}" for k in range(4))) for i in range(50)]
    split = collocations.frequent_prefixes(spark.createDataFrame(rows, "lang string, text string"), 1.0)
    assert split == {"en": {b"the": 6}}  # a share of 4/11, times 16 parts


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_001, 3_000_000_000_007, 4_000_000_000_003)], "a bigint, l bigint, r bigint")
    a, left, right = df.first()
    assert df.select(collocations.score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_vocabularies_beyond_the_packed_keys():
    chunk = collocations.Chunk()
    chunk.numbers |= {b"#%d" % i: i + 1 for i in range(1 << 21)}
    chunk.add("en", "a b a b. a c a b")
    words = {v: k.decode() for k, v in chunk.numbers.items()}
    w, x, y, n = chunk.counts(chunk.parts["en"])
    got = {tuple(words[v] for v in k): c for *k, c in zip(w.tolist(), x.tolist(), y.tolist(), n.tolist())}
    assert got == {("a", "b", "a"): 1, ("b", "a", "b"): 1, ("a", "b", ""): 2, ("b", "", ""): 2, ("a", "c", "a"): 1, ("c", "a", "b"): 1}


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).collect() == []


# --- vector packing ---------------------------------------------------------------------------------
def checked(length, loss, limits):
    placed = vector_packing.pack_pieces(np.array(length, np.int64), np.array(loss, np.int64), limits)
    parts, sequences = defaultdict(list), defaultdict(list)
    for piece, start, n, sequence, offset in placed:
        free = length[piece] - loss[piece]
        parts[piece].append((start, n))
        sequences[sequence].append((offset, n, max(0, start + n - max(start, free))))
    assert sorted(parts) == list(range(len(length)))
    for piece, spans in parts.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == length[piece]
    for spans in sequences.values():
        at = 0
        for offset, n, _ in sorted(spans):
            assert offset == at
            at += n
        assert at == limits.tokens or at & (at - 1) == 0
        assert len(spans) <= limits.segments and sum(s[2] for s in spans) <= limits.loss
    return placed


def test_every_limit_holds_and_nothing_is_padded():
    r = random.Random(7)
    for _ in range(200):
        limits = vector_packing.Limits(r.choice([16, 64, 100]), r.choice([1, 2, 5, 20]), r.choice([8, 16, 64, 100]))
        length = [r.randint(1, limits.tokens) for _ in range(r.randint(0, 60))]
        checked(length, [r.randint(0, min(n, limits.loss)) for n in length], limits)


def brute_first(length, loss, limits):
    """The pieces of the first sequence by the dot product, from the definition."""
    share = [(n / limits.tokens, 1 / limits.segments, q / limits.loss) for n, q in zip(length, loss)]
    mean = [sum(s[d] for s in share) / len(share) for d in range(3)]
    left, room, chosen = set(range(len(length))), [limits.tokens, limits.segments, limits.loss], []
    while True:
        fits = [i for i in left if length[i] <= room[0] and room[1] >= 1 and loss[i] <= room[2]]
        if not fits:
            return chosen
        caps = (limits.tokens, limits.segments, limits.loss)
        best = max(fits, key=lambda i: sum(share[i][d] * mean[d] * room[d] / caps[d] for d in range(3)))
        chosen.append((length[best], loss[best]))
        left.remove(best)
        room = [room[0] - length[best], room[1] - 1, room[2] - loss[best]]


def test_the_dot_product_chooses():
    r = random.Random(8)
    for _ in range(60):
        limits = vector_packing.Limits(1000, 8, 600)
        length = [r.randint(1, 500) for _ in range(30)]
        loss = [r.randint(0, n) for n in length]
        want = brute_first(length, loss, limits)
        placed = vector_packing.pack_pieces(np.array(length), np.array(loss), limits)
        got = [(length[p], loss[p]) for p, start, _, sequence, _ in placed if sequence == 0 and start == 0]
        kept = min(len(want), len(got))
        assert got[:kept - 1] == want[:kept - 1]


def test_few_pieces_are_cut():
    r = random.Random(9)
    length = [min(4095, 1 + int(r.lognormvariate(5.5, 1.2))) for _ in range(4000)]
    placed = checked(length, length, vector_packing.Limits())
    sequences = len({p[3] for p in placed})
    assert len(placed) <= len(length) + sequences and sequences <= sum(length) // 4096 + 13


def test_packed_documents(spark):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["the", "quick", "zürich", "9", "lazily"]) for _ in range(r.choice([0, 1, 40, 900, 6000])))) for i in range(60)]
    rows += [(70, None), (70, None), (71, "a " * 8191), (72, "a " * 4095), (None, "b c"), (73, "")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, row string, length int")
    got = vector_packing.pack_examples(df, WORDS).collect()
    want = Counter()
    for i, t in rows:
        want[(i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    ids_of = defaultdict(list)
    for (i, ids), n in want.items():
        ids_of[i] += [ids] * n
    for i, lists in ids_of.items():
        pieces = [p for p in got if p.doc_id == i]
        assert sum(p.length for p in pieces) == sum(map(len, lists))
        for p in pieces:
            assert p.doc_tokens in map(len, lists)
            assert p.ids_crc32 in {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4")) for ids in lists if len(ids) == p.doc_tokens}
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
        assert len(spans) <= 256
    assert vector_packing.pack_examples(df.limit(0), WORDS).collect() == []


def test_prompts_bear_no_loss(spark):
    rows = [(i, "ask " * (3 * i), "tell " * (2 * i)) for i in range(40)] + [(50, None, "x"), (51, "x", None)]
    limits = vector_packing.Limits(64, 4, 24)
    got = vector_packing.pack_examples(spark.createDataFrame(rows, "doc_id bigint, prompt string, text string"), WORDS, limits,
                                       prompt_column="prompt").collect()
    for i, _, text in rows:
        assert sum(p.loss_tokens for p in got if p.doc_id == i) == len((text or "").split()) + 1
    for sequence in {p.sequence_id for p in got}:
        held = [p for p in got if p.sequence_id == sequence]
        assert len(held) <= 4 and sum(p.loss_tokens for p in held) <= 24 and sum(p.length for p in held) <= 64
