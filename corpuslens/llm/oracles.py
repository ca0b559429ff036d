"""DuckDB SQL for the operators that SQL can express."""

#: Of links (a, b) in both directions over vertices (id): the smallest id that each reaches.
COMPONENTS = """
reach(id, seen) AS (SELECT id, id FROM vertices UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
component AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
"""

OP4 = f"""
WITH RECURSIVE fine AS (
    SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
vertices AS (SELECT vec_id AS id FROM embeddings),
{COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM component LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = id
"""

# five hexadecimal digits are four digits of base 32
_GROUP = "CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)"
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({group} >> {shift}) & 31 AS BIGINT) + 1, 1)"
_BASE32 = "array_to_string(list_transform(range(8), lambda g: " + " || ".join(
    _DIGIT.format(group=_GROUP, shift=s) for s in (15, 10, 5, 0)) + "), '')"

OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""

OP9 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id AS id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS words
    FROM documents),
s AS (
    SELECT DISTINCT id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1 : i + 5], ' ')) END) AS shingle
    FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
links AS (
    SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.id <> y.id
    JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id
    GROUP BY x.id, y.id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
vertices AS (SELECT id FROM w),
{COMPONENTS}
SELECT component.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM component LEFT JOIN n ON n.id = component.id
"""

OP12 = """
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS s FROM p),
one AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(s) AS w FROM t) GROUP BY ALL),
two AS (
    SELECT lang, g.w AS w, g.x AS x, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(s)), lambda i: {'w': s[i], 'x': s[i + 1]})) AS g FROM t) GROUP BY ALL),
three AS (
    SELECT lang, g.w AS w, g.x AS x, g.y AS y, count(*) AS f
    FROM (SELECT lang, unnest(list_transform(range(1, len(s) - 1), lambda i: {'w': s[i], 'x': s[i + 1], 'y': s[i + 2]})) AS g FROM t)
    GROUP BY ALL HAVING count(*) >= 10),
longest AS (
    SELECT lang, w, x, max(f) AS longer
    FROM (SELECT lang, w, x, f FROM three UNION ALL SELECT lang, x, y, f FROM three) GROUP BY ALL),
cuts AS (
    SELECT two.lang, two.w || ' ' || two.x AS phrase, 1 AS k, two.f AS a, l.f AS l, r.f AS r
    FROM two JOIN one l USING (lang, w) JOIN one r ON r.lang = two.lang AND r.w = two.x LEFT JOIN longest USING (lang, w, x)
    WHERE two.f >= 10 AND coalesce(100 * longer < 50 * two.f, true)
    UNION ALL
    SELECT three.lang, three.w || ' ' || three.x || ' ' || three.y, 1, three.f, l.f, r.f
    FROM three JOIN one l USING (lang, w) JOIN two r ON r.lang = three.lang AND r.w = three.x AND r.x = three.y
    UNION ALL
    SELECT three.lang, three.w || ' ' || three.x || ' ' || three.y, 2, three.f, l.f, r.f
    FROM three JOIN two l USING (lang, w, x) JOIN one r ON r.lang = three.lang AND r.w = three.y),
scored AS (
    SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
words AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op4_embedding_dedup": OP4, "op8_warc": OP8, "op9_ngram_jaccard": OP9, "op12_collocations": OP12}
