"""Classifiers by held-out accuracy, embeddings and personal data by brute force, and the pipeline."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from corpuslens.llm import embeddings, ngram_join, privacy, quality, token_counts, toxicity, word_bpe
from corpuslens.llm.common import labelled_sample

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- classifiers ----------------------------------------------------------------------------------------
def held_out_rates(scored, labels, label):
    """Shares of held-out rows of class 1 and 0 that are predicted so."""
    rows = scored.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()
    share = lambda y: np.mean([r["predicted"] == y for r in rows if r[label] == y])
    return share(1), share(0)


@needs_tables
def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    found, clean = held_out_rates(toxicity.toxicity_scores(docs, labels), labels, "toxic")
    assert found > 0.85 and clean > 0.95


@needs_tables
def test_quality_on_the_held_out_fold(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    good, bad = held_out_rates(quality.quality_scores(docs, labels), labels, "quality")
    assert good > 0.97 and bad > 0.85


@pytest.mark.parametrize("module, run", [(toxicity, toxicity.toxicity_scores), (quality, quality.quality_scores)])
def test_odd_rows_of_a_classifier(spark, module, run):
    docs = spark.createDataFrame([(1, "good words"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "bad " * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 0, 1), (9, None, 5), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = run(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert all(r["score"] == 0.5 for r in run(docs, labels.limit(0)).collect())
    assert run(docs.limit(0), labels).count() == 0


def test_no_row_is_dropped_as_toxic_without_labels(spark):
    docs = spark.createDataFrame([(1, "good words"), (2, None), (3, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert sorted(toxicity.keep(docs, toxicity.fit(docs, labels)).collect()) == sorted(docs.collect())


def test_spans_point_at_toxic_words():
    r = random.Random(10)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(240):
        text = [r.choice(words) for _ in range(30)]
        if i % 3 == 0:
            text[r.randrange(30)] = "Zorkish"
        rows.append((i, int(i % 3 == 0), " ".join(text)))
    model = toxicity.fit_rows(rows)
    scores, spans = toxicity.score_texts(model, ["abc zorkish def", "abc def", ""])
    assert scores[0] > 0.5 > scores[1] and [(s["start"], s["end"]) for s in spans[0]] == [(4, 11)] and spans[1:] == [[], []]


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(toxicity, "SEGMENT", 4)
    lengths = np.array([0, 1, 7, 11])
    e, ties, start = rng.normal(size=19), (-1.0, 0.3, -0.5), -0.7
    got, counts = toxicity.forward_backward(e, lengths, ties, start, pairs=True)
    want, want_counts, at = [], np.zeros(3), 0
    weight = {(0, 0): 0.0, (0, 1): ties[0], (1, 0): ties[1], (1, 1): ties[2]}
    for n in lengths:
        total, marginal, expected = 0.0, np.zeros(n), np.zeros(3)
        for code in range(1 << n):
            path = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * z for k, z in enumerate(path)) + (start * path[0] if n else 0) + sum(weight[p] for p in zip(path, path[1:])))
            total += w
            marginal += w * np.array(path)
            expected += w * np.array([sum(p == q for p in zip(path, path[1:])) for q in ((0, 1), (1, 0), (1, 1))])
        want.extend(marginal / total)
        want_counts += expected / total
        at += n
    assert np.allclose(got, want, atol=1e-6) and np.allclose(counts, want_counts, atol=1e-6)


# --- embeddings -------------------------------------------------------------------------------------------
def brute_links(rows, least=0.98):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, v, l), (j, w, m) = ok[a], ok[b]
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in root}


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vectors = [b + rng.normal(size=16) * s for b in base for s in (0, 0, 0.02, 0.05, 0.1, 0.3)]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(150)]
    rows += [(2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1),
             (2005, rows[0][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [], 1), (2009, [3.0], 1), (2010, [5.0], 1),
             (2011, [float("inf")] + [1.0] * 15, 1), (2012, [-2 * x for x in rows[0][1]], 0), (2013, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, n string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_links_of_spread_cells_count_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "PART", 16)
    rng = np.random.default_rng(5)
    # families that the threshold cuts through, of up to 150 vectors
    rows = [(i * 1000 + j, [float(x) for x in b + rng.normal(size=12) * 0.14], i % 2)
            for i, b in enumerate(rng.normal(size=(8, 12))) for j in range(10 + 20 * i)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embeddings.near_duplicates(df).collect()}
    want = brute_links(rows)
    assert sum(got[i][0] for i in want) >= 0.995 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i][0] for i in want) % 2 == 0


def test_one_visit_finds_links_of_both_sides():
    v = np.array([[1.0, 0.0], [0.999, 0.0447], [0.0, 1.0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    held = {"id": np.array([10, 20, 30]), "n": np.array([1, 4, 1]), "v": v, "ask": np.array([[0], [0], [0]])}
    asks = {"id": np.array([10]), "n": np.array([2]), "v": v[:1], "cell": np.array([5])}
    # 20 does not visit cell 5, so the link counts for it here; with cell 0 it does
    assert embeddings.matches(asks, held, 0.98).to_pylist() == [{"id": 10, "others": 4, "root": 10}, {"id": 20, "others": 2, "root": 10}]
    asks["cell"] = np.array([0])
    assert embeddings.matches(asks, held, 0.98).to_pylist() == [{"id": 10, "others": 4, "root": 10}, {"id": 20, "others": 0, "root": 10}]
    assert embeddings.tied(5, np.array([3, 4]), np.array([4, 1])).tolist() == [0, 1, 2, 1, 1]


def test_codebooks_grow_with_the_table():
    sample = np.random.default_rng(6).normal(size=(3000, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    sizes = [len(embeddings.fit(sample, n, 8, 0.98, 0.995).left) for n in (100, 10**5, 10**8)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(3)
    left, right = rng.random(6), rng.random(5)
    order = list(embeddings.visits(left, right))
    assert len(set(order)) == 30
    sums = [left[i] + right[j] for i, j in order]
    assert sums == sorted(sums)


# --- personal data ------------------------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = lambda v: 2 * v - 9 if v > 4 else 2 * v
        return 12 <= len(digits) <= 19 and sum(doubled(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if fits(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("ab@@..--__%+ 0123456789()é😀\n") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(r.choice("0123456789 -") for _ in range(r.randint(10, 60))) for _ in range(800)]
    texts += ["a@b.c_d@e.f x", " 1.2.3.4.5.6.7.8 ", "0255.1.1.1 1.2.3.256", "4111 1111 1111 1111", "4111111111111111" * 3, "+1 (136) 555-7479",
              "1 " * 20000, "9" * 20000, "a@" * 9000, "1." * 9000, "+1 " * 9000, "a" * 20000, "", None]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    got = privacy.private_data(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, base string")).collect()
    assert len(got) == len(rows)
    for x in got:
        want = brute_spans(texts[x["doc_id"]] or "")
        assert ",".join(s for s in x["spans"].split(",") if not s.startswith("term")) == want
        assert x["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in PATTERNS] == [want.count(f"{k}:") for k in PATTERNS]
    assert privacy.private_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_disclosing_terms_are_found_and_removed(spark):
    common = "the report was sent by mail to all of them"
    rows = [(i, f"{common} and some more {i}") for i in range(200)]
    rows += [(900 + i, f"note {i}: write to Zanzibar desk, ann@x.org, the report") for i in range(4)]
    rows += [(950, "the report: bob@x.org"), (951, None), (952, "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n_chars int")
    got = {x["doc_id"]: x for x in privacy.private_data(df).collect()}
    text = dict(rows)[901]
    terms = {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[901]["spans"].split(",")) if kind == "term"}
    assert "Zanzibar" in terms and not terms & {"the", "report"} and got[950]["n_term"] == 0
    clean = {x["doc_id"]: x for x in privacy.sanitise(df).collect()}
    assert "Zanzibar" not in clean[901]["text"] and "[email]" in clean[901]["text"] and clean[901]["n_chars"] == 7
    assert clean[3]["text"] == dict(rows)[3] and clean[951]["text"] is None and clean[952]["text"] == "" and len(clean) == len(rows)


def brute_terms(rows, share=0.9):
    """Spans of the words that disclose an entity, by (id, text): counts over whole documents."""
    same = {"email": str.lower, "ip": lambda m: ".".join(str(int(x)) for x in m.split("."))}
    number = lambda m: re.sub("[^0-9]", "", m)
    found, words = {}, {}
    for row in set(rows):
        found[row] = [(m.start(), m.end(), (k, same.get(k, number)(m[0]))) for k, p in PATTERNS.items() for m in re.finditer(p, row[1]) if fits(k, m[0])]
        words[row] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", row[1])]
    docs = lambda e=None, t=None: {r for r in found if (e is None or e in {x[2] for x in found[r]}) and (t is None or t in {x[2] for x in words[r]})}
    out = {}
    for row in found:
        telling = set()
        for e in {x[2] for x in found[row]}:
            p = len(docs(e)) / len(found)
            telling |= {t for _, _, t in words[row] if p < 1 and np.log2(len(docs(e, t)) / len(docs(t=t)) / p) >= -share * np.log2(p)}
        out[row] = {(a, b) for a, b, t in words[row] if t in telling and not any(a < y and x < b for x, y, _ in found[row])}
    return out


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(12)
    names = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(90)]
    held = ["ann@x.org", "Ann@X.org", "bob@y.net", "10.0.0.1", "010.0.0.1", "1.23.4.5", "12.3.4.5", "+49 30 1234567", "+49 (30) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    rows = []
    for i in range(160):
        text = [r.choice(names).title() if r.random() < 0.2 else names[int(90 * r.random() ** 3)] for _ in range(r.randint(1, 30))]
        for _ in range(r.choice([0, 0, 1, 2])):
            text.insert(r.randrange(len(text) + 1), r.choice(held) if r.random() < 0.7 else f"{r.choice(names)}{i}@z.org")
        rows.append((i, ", ".join(text)))
    rows += rows[:40]
    rows.append((900, " ".join(f"filler{'abcdefghij'[k % 10]} common" for k in range(700)) + " far@z.org " + "common " * 600 + "Quetzal"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, got = brute_terms(rows), privacy.private_data(df).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 100
    texts = dict(rows)
    for x in got:
        spans = {tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("term")}
        assert spans == want[x["doc_id"], texts[x["doc_id"]]] and len(spans) == x["n_term"]


def test_a_disclosing_term_goes_wherever_it_stands(spark):
    """Far from the entity, again, beside other spellings of it, and for an entity of one document."""
    filler = " the report was sent by mail to all of them" * 5
    rows = [(i, f"{filler} {i}") for i in range(300)]
    rows += [(900, f"Zanzibar{filler} ann@x.org{filler} 7 zanzibar"), (901, f"ANN@x.org{filler} Zanzibar"),
             (902, f"+49 30 1234567{filler} Quetzal{filler} quetzal")]
    clean = {x["doc_id"]: x["text"] for x in privacy.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert clean[900] == f"[term]{filler} [email]{filler} 7 [term]"
    assert clean[901] == f"[email]{filler} [term]" and clean[902] == f"[phone]{filler} [term]{filler} [term]"
    assert all(clean[i] == t for i, t in rows[:300])


def test_main_path_of_personal_data_is_native(spark):
    plan = privacy.entities(spark.createDataFrame([(1, "a@b.c")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- pipeline -------------------------------------------------------------------------------------------------
@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = read(spark, "documents", sf).limit(150).cache()
    columns, n = docs.columns, 150
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, docs, sf)
        assert after.columns == columns, name
        rows = after.collect()
        assert len(rows) <= n and len({r["doc_id"] for r in rows}) == len(rows)
        docs, n = spark.createDataFrame(rows, docs.schema), len(rows)
    assert n > 50
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n
    empty = docs.limit(0)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty, sf).count() == 0


# --- texts with very many matches, odd columns ---------------------------------------------------------------
def test_many_matches_take_time_in_proportion(spark):
    def seconds(m):
        df = spark.createDataFrame([(1, "10.0.0.1 x " * m)], "doc_id bigint, text string")
        start = time.perf_counter()
        assert privacy.sanitise(df).first()["text"] == "[ip] x " * m
        return time.perf_counter() - start

    seconds(10)
    few, many = seconds(10_000), seconds(40_000)
    assert many < 6 * few + 5


def test_private_data_where_columns_clash(spark):
    rows = [(1, "write to a@b.co now", "k1", 5, "s"), (2, None, "k2", 6, None), (2, "a@b.co", "k3", 7, "t"), (1, "write to a@b.co now", "k4", 8, "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, __key int, spans string")
    got = sorted(map(tuple, privacy.sanitise(df).collect()), key=lambda r: r[2])
    assert [r[2:] for r in got] == [r[2:] for r in sorted(rows, key=lambda r: r[2])]
    assert got[1][1] is None and got[2][1] == "[email]" and "a@b.co" not in got[0][1] + got[3][1]


def test_first_of_a_group_where_columns_clash(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, 1, 2), (2, words, 3, 4), (3, "other words", 5, 6), (3, "other words", 7, 8), (None, words, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __gone int, root int")
    got = ngram_join.keep_first(df)
    assert got.columns == df.columns and sorted([r[0] for r in got.collect()], key=str) == [1, 3, None]


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_drop_nothing(spark, module, label):
    rows = [(1, "good words", "p"), (2, None, "q"), (3, "", "r"), (3, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, label, label) for i in range(20)], "doc_id bigint, toxic int, quality int")
    got = module.keep(docs, module.fit(docs, labels))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_an_id_with_two_labels_is_no_example(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in (1, 2, 3, 4) for k in range(3)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (4, 0)], "doc_id bigint, toxic int")
    kept = {i for i in (2, 3, 4) if zlib.crc32(str(i).encode()) % 5}
    got = labelled_sample(docs, labels, "toxic", 10, 100)
    assert {r[0] for r in got} == kept and len(got) == len(kept)


def test_spans_are_places_of_the_text_itself():
    r = random.Random(10)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(i, int(i % 3 == 0), " ".join([*(r.choice(words) for _ in range(29)), "Zorkish" if i % 3 == 0 else "abc"])) for i in range(240)]
    scores, spans = toxicity.score_texts(toxicity.fit_rows(rows), ["İİİ zorkish def", "İİİ ZORKISH def"])
    assert [[(s["start"], s["end"]) for s in x] for x in spans] == [[(4, 11)], [(4, 11)]]


def test_long_words_are_not_remembered():
    counter = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    counter.count("x" * 100_000 + " y")
    assert max(map(len, counter.units)) <= token_counts.LONGEST_REMEMBERED
    bpe = word_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(3):
        list(bpe.encode([f"{i}" + "x" * word_bpe.REMEMBERED_CHARS]))
        assert bpe.chars <= word_bpe.REMEMBERED_CHARS + 1


def test_quality_reads_whole_sampled_texts():
    head = [b"common start of every text " * 600 for _ in range(40)]
    tails = [b"unusual ending %d that only stands behind the first part " % (i % 3) * 200 for i in range(40)]
    made = quality.dictionary([h + t for h, t in zip(head, tails)], 20_000, np.random.default_rng(1))
    assert b"unusual ending" in made


def test_quality_scores_follow_the_definition():
    good = [f"the {a} {b} went over the {c}" * 20 for a in ("cat", "dog") for b in ("old", "red") for c in ("hill", "road")] * 4
    bad = [f"{a}{b}{a} buy buy {c} now" * 20 for a in ("xx", "yy") for b in ("qq", "zz") for c in ("pills", "gold")] * 4
    train = lambda rows: quality.dictionary([t.encode() for t in rows], 4000, np.random.default_rng(1))
    model = quality.Model(train(good), train(bad), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.1, 2.0, -0.5, 0.25))
    for text in ("", "é", good[0], bad[0], good[1] * 9 + bad[2] * 3):
        data = text.encode()
        sizes = []
        for dictionary in (model.good, model.bad):
            own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
            sizes.append(sum(len(own.compress(data[i : i + 1024])) - 12 for i in range(0, len(data), 1024)))
        g, b = sizes
        rate = np.log((max(min(g, b), 0) + 1) / (len(data) + 1))
        x = 0.1 + 2 * (b - g) / (max(b + g, 0) + 1) - 0.5 * rate + 0.25 * rate * rate
        assert abs(quality.score_text(model, text) - 1 / (1 + np.exp(-x))) < 1e-9
    assert quality.features(model, good[0])[0] > 0 > quality.features(model, bad[0])[0]
