"""Information-theoretic sanitisation, with DataFrame and SQL functions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers; their spans are found by patterns. An
entity is the same however it is written: addresses in lower case, IP addresses without leading zeros, numbers by
their digits. Words of the documents that hold an entity may reveal it. Over the corpus, for a term t and an entity e:

    IC(e) = -log2 P(e)            P(e) = documents with e / documents
    PMI(t, e) = log2 (P(e | t) / P(e))     P(e | t) = documents with t and e / documents with t

A term discloses an entity where PMI(t, e) >= `SHARE` * IC(e): with t known, at most the share 1 - SHARE of the
entity's information is left. For an entity of one document this compares the term's own information with the
entity's, so no entity is too rare. Words anywhere in a document count, those inside entities too. Disclosing terms
are spans of the kind `term` wherever they stand in a document that holds the entity, outside the entities
themselves. Documents without the entity keep the term: they hold nothing that it could disclose. Sanitising replaces
entities by the name of their kind and disclosing terms by `[term]`; terms are removed, not generalised, as there is
no taxonomy to take a broader word from.

Spans are in code points, the end exclusive. Terms are whole words of at least `LEAST_LETTERS` letters. Each pattern
is linear in the text: runs are matched possessively and from their first character on, which leaves the matches of
the plain patterns as they are.

Nulls count as empty texts and have no spans. Repeated rows (same id and text) count as one document in the
statistics and come back each. Rows of one id with different texts are apart. A null id is an id of its own. An
empty table gives an empty result. Sanitising keeps all other columns, null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import stage

SHARE = 0.9
LEAST_LETTERS = 3
KINDS = ("email", "ip", "card", "phone", "term")

#: (pattern, a part without which a text has no match). A run of the first class is entered at its start, or where the last match ended.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # a whole run of digits with single separators; 12 to 19 digits
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])(?![\x20-][0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = rf"\p{{L}}{{{LEAST_LETTERS},}}+"


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def in_blocks(items: Column, at: Column, reach, step, out_type: str) -> Column:
    """What `step` puts out along an array, with a running position, in two levels of blocks.

    reach(position, item) is the position after an item; step(position, item) is an array of what it gives. An array grows
    by copying, so one pass over n items would copy n * n / 2; the square root of n blocks copy n times its square root.
    """
    def whole(items: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))),
                             lambda k: F.slice(items, k * size + 1, size))
        return bound(blocks, placed_blocks)

    def placed_blocks(blocks: Column) -> Column:
        after = lambda acc, block: F.aggregate(block, acc, reach)
        starts = F.aggregate(blocks, F.array(at), lambda acc, block: F.concat(acc, F.array(after(F.element_at(acc, -1), block))))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inside))

    def inside(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.expr(f"CAST(array() AS {out_type})").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(
            reach(acc["at"], x).alias("at"), F.concat(acc["out"], step(acc["at"], x)).alias("out")), lambda acc: acc["out"])

    return bound(items, whole)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches: the pieces between matches give the places."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match")))
    kind = "array<struct<start:int,end:int,match:string>>"
    end = lambda at, x: at + x["gap"] + F.coalesce(x["size"], F.lit(0))
    here = lambda at, x: F.array(F.struct((at + x["gap"]).alias("start"), end(at, x).alias("end"), x["match"].alias("match")))
    return in_blocks(pieces, F.lit(0), end, lambda at, x: F.when(
        x["match"].isNull(), F.expr(f"CAST(array() AS {kind})")).otherwise(here(at, x)), kind)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    backwards = F.reverse(digits(match))
    value = lambda i: F.substring(backwards, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    terms = F.transform(F.sequence(F.lit(1), F.length(backwards)), doubled)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


#: What is the same for all spellings of one entity.
SAME = {
    "email": F.lower,
    "ip": lambda m: F.regexp_replace(m, "(?<![0-9])0+(?=[0-9])", ""),
    "card": digits,
    "phone": digits,
}
CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": luhn,
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Array of (start, kind number, end, entity) of all protected entities, by start and kind."""
    def of(number: int, kind: str) -> Column:
        pattern, part = PATTERNS[kind]
        present = F.contains(text, F.lit(part)) if part else text.rlike("[0-9]")
        spans = F.filter(located(text, pattern), lambda s: CHECKS[kind](s["match"]))
        spans = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"),
            F.xxhash64(F.lit(kind), SAME[kind](s["match"])).alias("entity")))
        return F.when(present, spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,entity:bigint>>)"))

    found = [of(number, kind) for number, kind in enumerate(KINDS[:4])]
    return F.array_sort(F.concat(*found))


def term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def word_pieces(text: Column) -> Column:
    """Array of (gap, size, term): each word with the length of what stands before it; the last has no word."""
    return F.zip_with(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda gap, match: F.struct(
        F.length(gap).alias("gap"), F.length(match).alias("size"), F.when(match.isNotNull(), term(match)).alias("term")))


def placed(once: DataFrame) -> DataFrame:
    """key, start, end, term of every word of `entities`, one row a key; sums run along the words of a row, so work is linear."""
    rows = once.select("key", F.posexplode("words").alias("pos", "w")).select("key", "pos", "w.*")
    along = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(along).cast("int"))
    return rows.where("term IS NOT NULL").select("key", (F.col("end") - F.col("size")).alias("start"), "end", "term")


def row_key(id_: Column, text: Column) -> Column:
    """Tells rows apart by id and text, with 96 bits."""
    return F.concat_ws(":", F.xxhash64(id_, text), F.hash(text, id_))


def entities(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key, base, words: spans of every row, and the `word_pieces` of the rows that have any."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.select("id", row_key(F.col("id"), F.col("text")).alias("key"), "base",
                       F.when(F.size("base") > 0, word_pieces(F.col("text"))).alias("words"))


def entity_classes(once: DataFrame) -> DataFrame:
    """key, who: the entities of each document; those that stand in the same documents are one class.

    who: (documents, two hashes of their keys). The terms that disclose one entity of a class disclose them all.
    """
    held = once.select("key", F.explode(F.array_distinct(F.col("base.entity"))).alias("entity"))
    who = F.struct(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    classes = stage(held.groupBy("entity").agg(who.alias("who"), F.min("key").alias("key")), "classes")
    single = classes.where("who.docs = 1").select("key", "who")
    shared = held.join(classes.where("who.docs > 1").select("entity", "who"), "entity").select("key", "who")
    return single.unionByName(shared).distinct()


def term_documents(df: DataFrame, repeats: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """term, term_docs: documents with each word; repeats: (key, extra) of the rows that stand more than once."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    # distinct words of a text, counted before they are shuffled
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), term))
    counted = df.select(F.explode(words).alias("term"), F.lit(1).cast("long").alias("n"))
    if not repeats.isEmpty():
        again = df.select(row_key(F.col(id_column), text).alias("key"), words.alias("words")).join(repeats, "key").dropDuplicates(["key"])
        counted = counted.unionByName(again.select(F.explode("words").alias("term"), (-F.col("extra")).alias("n")))
    return counted.groupBy("term").agg(F.sum("n").alias("term_docs"))


def disclosing_terms(found: DataFrame, df: DataFrame, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, term: the terms that disclose an entity of the document, by counts over all documents; found: `entities` of df."""
    repeats = stage(found.groupBy("key").agg((F.count("*") - 1).alias("extra")).where("extra > 0"), "repeats")
    total = df.count() - (repeats.agg(F.sum("extra")).first()[0] or 0)
    once = found.where("size(base) > 0").dropDuplicates(["key"])
    terms = once.select("key", F.array_compact(F.array_distinct(F.col("words.term"))).alias("terms"))
    pairs = stage(terms.join(entity_classes(once), "key").select("key", "who", F.explode("terms").alias("term")), "pairs")
    together = pairs.groupBy("term", "who").agg(F.count("*").alias("together"))
    rated = together.join(term_documents(df, repeats, id_column, text_column), "term")
    information = -F.log2(F.col("who.docs") / total)
    pmi = F.log2(F.col("together") * total / (F.col("term_docs") * F.col("who.docs")))
    telling = rated.where((information > 0) & (pmi >= share * information)).select("term", "who")
    return pairs.join(telling, ["term", "who"]).select("key", "term").distinct()


def spans(df: DataFrame, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key, base, terms of every row: arrays of (start, kind, end)."""
    found = stage(entities(df, id_column, text_column), "entities")
    telling = stage(disclosing_terms(found, df, share, id_column, text_column), "telling")
    words = placed(found.where("size(words) > 0").dropDuplicates(["key"]).select("key", "words"))
    narrow = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    hits = words.join(telling, ["key", "term"]).select("key", "start", "end", F.lit(4).alias("kind")).distinct()
    # words inside an entity go with it: of the entities from the left, and from the right, the nearest end and start
    marked = hits.unionByName(found.where("size(words) > 0").dropDuplicates(["key"]).select("key", F.explode(narrow).alias("s")).select(
        "key", "s.start", "s.end", "s.kind"))
    base, places = F.col("kind") < 4, ("start", "kind", "end")
    # two running frames: one that reaches to the end would be worked out anew for each row
    so_far = lambda order: Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("left", F.max(F.when(base, F.col("end"))).over(so_far(map(F.asc, places))))
    marked = marked.withColumn("right", F.min(F.when(base, F.col("start"))).over(so_far(map(F.desc, places))))
    outside = marked.where("kind = 4 AND coalesce(left <= start, true) AND coalesce(right >= end, true)")
    hits = outside.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("terms"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    rows = found.select("id", "key", narrow.alias("base")).join(hits, "key", "left")
    return rows.select("id", "key", "base", F.coalesce("terms", none).alias("terms"))


def joined(column: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def private_data(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, counts of each kind, digest of the base spans, and all spans as text."""
    rows = spans(df, id_column=id_column, text_column=text_column)
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return rows.select(
        F.col("id").alias(id_column), *(count(n).alias(f"n_{KINDS[n]}") for n in range(4)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with entities replaced by `[kind]` and disclosing terms by `[term]`; all other columns as they are."""
    # columns of the input with the same names stay apart in a struct; one row a key: repeated rows have the same spans
    marks = spans(df, id_column=id_column, text_column=text_column).dropDuplicates(["key"]).select(
        "key", F.array_sort(F.concat("base", "terms")).alias("spans")).where("size(spans) > 0")
    rows = df.select(F.struct(*df.columns).alias("row"), row_key(F.col(id_column), F.coalesce(text_column, F.lit(""))).alias("key"))
    text = F.col("row").getField(text_column)
    return rows.join(marks, "key", "left").select(*[
        F.when(F.col("spans").isNull(), text).otherwise(replaced(text, F.col("spans"))).alias(c) if c == text_column
        else F.col("row").getField(c).alias(c) for c in df.columns])


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of its spans, sorted by start, replaced by the name of its kind.

    A span that begins within an earlier one only lengthens it. Places in a text are found from its start, so blocks of
    spans work on their part of the text.
    """
    names = F.array(*map(F.lit, KINDS))

    def whole(spans: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(spans))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / size).cast("int") - 1), lambda k: F.slice(spans, k * size + 1, size))
        return bound(blocks, lambda blocks: bound(F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(
            F.aggregate(block, F.element_at(acc, -1), lambda at, s: F.greatest(at, s["end"]))))), lambda starts: assembled(blocks, starts)))

    def assembled(blocks: Column, starts: Column) -> Column:
        ends = F.slice(starts, F.lit(2), F.size(blocks))
        parts = F.zip_with(F.arrays_zip(blocks.alias("b"), F.slice(starts, F.lit(1), F.size(blocks)).alias("s")), ends, lambda x, end: block_text(
            x["b"], x["s"], F.substring(text, x["s"] + 1, end - x["s"])))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(starts, -1) + 1, F.length(text)))

    def block_text(block: Column, start: Column, part: Column) -> Column:
        return bound(part, lambda part_: F.aggregate(block, F.struct(start.alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")),
                                                     lambda acc, s: step_on(part_, start, acc, s), lambda acc: F.array_join(acc["out"], "")))

    def step_on(part: Column, start: Column, acc: Column, s: Column) -> Column:
        kept = F.substring(part, acc["at"] - start + 1, s["start"] - acc["at"])
        new = F.array(kept, F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    return bound(spans, whole)
