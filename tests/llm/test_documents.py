"""Fingerprints, archives and the Jaccard join against brute force."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import fingerprints, ngram_join, warc
from corpuslens.llm.components import components

SCHEMA = "doc_id bigint, text string"


# --- fingerprints -----------------------------------------------------------------------------------
def brute_winnow(text, k, window):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) < k:
        return [0] if len(points) else []
    h = [int(fingerprints.rolling_hashes(points[i : i + k], k)[0]) for i in range(len(points) - k + 1)]
    w = min(window, len(h))
    chosen = []
    for i in range(len(h) - w + 1):
        best = min(range(i, i + w), key=lambda j: (h[j], -j))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return chosen


@pytest.mark.parametrize("k, window", [(5, 4), (24, 64), (3, 7)])
def test_winnowing_equals_brute_force(k, window):
    r = random.Random(4)
    for n in (0, 1, 2, 4, 5, 8, 30, 100, 400):
        text = "".join(r.choice("ab😀") for _ in range(n))
        assert fingerprints.winnow(text, k, window)[1].tolist() == brute_winnow(text, k, window)


def test_blocks_do_not_change_the_choice(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("abc ") for _ in range(3000)) + "a" * 500
    whole = fingerprints.winnow(text)
    monkeypatch.setattr(fingerprints, "BLOCK", 200)
    parts = fingerprints.winnow(text)
    assert whole[1].tolist() == parts[1].tolist() and whole[0].tolist() == parts[0].tolist()


def test_shared_passages_share_entries():
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(fingerprints.K + fingerprints.WINDOW - 1))
    a, b = ("".join(r.choice("ijklmnop") for _ in range(n)) + passage for n in (311, 77))
    assert len(np.intersect1d(fingerprints.winnow(a)[0], fingerprints.winnow(b)[0])) >= 1


def test_edited_texts(spark):
    r = random.Random(7)
    rows = [(i, "".join(r.choice("abcdé😀 ") for _ in range(r.choice([0, 1, 3, 50, 700])))) for i in range(120)]
    rows += [(500, None), (501, "x" * 300), (502, "x" * 300)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, part string").repartition(5)
    got = {x["doc_id"]: x for x in fingerprints.edited_fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        x = got[i]
        assert x["n_chars"] == n and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["fingerprint"] == fingerprints.written(fingerprints.winnow(t))
        assert x["near_next"] == fingerprints.likeness(fingerprints.winnow(t)[0], fingerprints.winnow(following)[0])
    assert got[501]["fingerprint"] == got[502]["fingerprint"] and got[502]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fingerprints.edited_fingerprints(spark.createDataFrame([(1, "ab"), (None, "c"), (1, "a")], SCHEMA)).count() == 3
    assert fingerprints.fingerprints(df).count() == len(rows)


# --- archives -----------------------------------------------------------------------------------------
def test_archives_come_back(spark):
    r = random.Random(8)
    large = "".join(r.choice("abcé\n\r ") for _ in range(5000))
    htmls = ["", None, "<p>x</p>", "<p>x</p>", "a\r\nb\n\n", "WARC/1.1\r\n\r\nContent-Length: 5\r\n", large, large + "y", "é" * 700, "0\r\n\r\n", "\n", "\r"]
    rows = [(i, f"http://h/{i}" if i else None, h, "z") for i, h in enumerate(htmls * 2)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string"), chunk=256).collect()
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", i)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        root = first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if root == i else "revisit",
                     None if root == i else root))
    assert sorted(map(tuple, got)) == sorted(want)


def test_cuts_end_between_characters():
    for text in ("", "a" * 10, "aé€😀" * 50, "😀" * 9):
        for chunk in (4, 5, 7, 64):
            pieces = list(warc.cuts(text, chunk))
            assert "".join(p.decode("utf-8") for p in pieces) == text and all(0 < len(p) <= chunk for p in pieces)
            assert all(len(p) > chunk - 4 for p in pieces[:-1])


def test_archive_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (3, "http://c", "é\n" * 10)], "page_id bigint, url string, html string")
    warc.write_archives(warc.mark_revisits(pages).coalesce(1), str(tmp_path / "w"), chunk=300)
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    kinds = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        kinds.append(re.search(rb"WARC-Type: (\w+)", head)[1])
        data = rest[size + 4 :]
    assert Counter(kinds) == {b"response": 2, b"revisit": 1}
    chunks = warc.read_archives(spark, str(tmp_path / "w")).where("record = '<urn:page:1>'").orderBy("chunk").collect()
    assert [c["bytes_so_far"] for c in chunks] == [300, 600, 900, 1000, 1000] and chunks[-1]["last"]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "yy"), (4, "u", "yy")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(pages, least_bytes=2).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# --- Jaccard join ---------------------------------------------------------------------------------------
def brute_components(rows):
    word = re.compile("[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = word.findall((t or "").translate(low))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def group(r, n, size, edits):
    vocabulary = [f"w{i}" for i in range(900)]
    base = [r.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(r.choice(edits)):
            words[r.randrange(size)] = r.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_components_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    texts = group(r, 150, 80, [0, 0, 1, 2, 2, 3, 4, 5, 6]) + group(r, 60, 9, [0, 1, 1, 2]) + group(r, 40, 4, [0, 0, 1])
    passage = group(r, 1, 60, [0])[0]
    texts += [" ".join(group(r, 1, r.randint(1, 50), [0])) + " " + passage for _ in range(100)]
    texts += ["", None, " \n", "One two", "one TWO", "a b c d e", "É x", "é x", "a b c d e f g h i", "A b c d e f g h i"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows)
    # long lists from 6 on, so that both ways are taken
    monkeypatch.setattr(ngram_join, "SHORT", 6)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    kept = {x["doc_id"] for x in ngram_join.keep_first(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n string")).collect()}
    assert kept == {c for _, c in want.values()}


def test_odd_rows_of_the_join(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    got = sorted(map(tuple, ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (3, 2, 1), (3, 2, 1), (None, 2, None)], key=str)
    assert ngram_join.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = ngram_join.keep_first(spark.createDataFrame([*rows, (5, "x"), (5, "x"), (5, "y")], SCHEMA)).collect()
    assert sorted([x["doc_id"] for x in kept], key=str) == [1, 5, None]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def linked(x, y):
    inter = len(np.intersect1d(x, y))
    return inter > 0 and 4 * inter >= 3 * (len(x) + len(y) - inter)


@pytest.mark.parametrize("halves", [False, True])
def test_blocks_find_the_links_between_components(halves):
    r = random.Random(12)
    for _ in range(20):
        common = [r.randrange(1 << 62) for _ in range(60)]
        sets = []
        for _ in range(60):
            kept = [x for x in common if r.random() < r.choice([0.5, 0.9, 0.97])]
            sets.append(np.unique(np.array(kept + [r.randrange(1 << 62) for _ in range(r.choice([0, 3, 30]))], np.uint64)))
        rows = [(i, i if r.random() < 0.7 else i % 5, s) for i, s in enumerate(sets)]
        left, right = (rows[:30], rows[30:]) if halves else (rows, None)
        found = ngram_join.block_links(left, right, {})
        assert all(linked(sets[a], sets[b]) for a, b in found)

        def groups(links):
            root = {c: c for _, c, _ in rows}
            def find(x):
                while root[x] != x:
                    x = root[x]
                return x
            for a, b in links:
                x, y = find(rows[a][1]), find(rows[b][1])
                root[max(x, y)] = min(x, y)
            return {c: find(c) for c in root}

        pairs = [(a, b) for a in range(60) for b in range(60) if (a < 30 <= b if halves else b < a) and linked(sets[a], sets[b])]
        assert groups(found) == groups(pairs)


def test_passages_that_many_documents_share(spark, monkeypatch):
    r = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(240):
        own = " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 20, 200])))
        rows.append((i, f"{own} {passage}" if i % 3 else own))
    rows += [(1000 + i, " ".join([*(f"c{k}" for k in range(80)), f"x{i}", f"y{i % 7}"])) for i in range(150)]
    monkeypatch.setattr(ngram_join, "SHORT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    sets = [ngram_join.shingle_sets([t])[0] for _, t in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: rows[find(k)][0] for k, (i, _) in enumerate(rows)}
