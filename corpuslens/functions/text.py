"""Column helpers for text: line rules, trimming, regular expressions.

All of them are native expressions; none brings Python into the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: characters that count as surrounding white space
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def universal_newlines(text: Column) -> Column:
    r"""``\r\n`` and a lone ``\r`` become ``\n``; text without ``\r`` passes untouched."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def drop_malformed_utf8(raw: Column) -> Column:
    """Binary -> string where malformed byte sequences disappear instead of failing the job."""
    text = raw.cast("string")
    replacement, shelter = "\ufffd", "\ufffe"
    # a genuine U+FFFD in the file must survive, so it is parked while malformed bytes are removed
    parked = F.replace(text, F.lit(replacement), F.lit(shelter))
    cleaned = F.replace(F.make_valid_utf8(parked), F.lit(replacement), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(cleaned, F.lit(shelter), F.lit(replacement)))


def newline_count(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def iterated_lines(text: Column) -> Column:
    r"""Lines as a text iterator yields them: ``""`` 0, ``"a\n"`` 1, ``"a\nb"`` 2."""
    tail = F.when((text == "") | F.endswith(text, F.lit("\n")), F.lit(0)).otherwise(F.lit(1))
    return newline_count(text) + tail


def split_lines(text: Column) -> Column:
    r"""Pieces between newlines: ``""`` 1, ``"a\n"`` 2 (on purpose not the rule above)."""
    return newline_count(text) + F.lit(1)


def strip(text: Column, chars: str = BLANKS) -> Column:
    return F.trim(text, F.lit(chars))


def lstrip(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: letters, digits and underscore in any script: what a word character is for the rules
WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"


def pattern(body: str, *, ignore_case: bool = False, dotall: bool = False, multiline: bool = False) -> str:
    r"""Java pattern text: Unicode classes, and only ``\n`` ends a line."""
    flags = "Ud" + ("i" if ignore_case else "") + ("s" if dotall else "") + ("m" if multiline else "")
    return f"(?{flags})" + body.replace(r"\w", WORD)


def one_line(body: str) -> str:
    r"""The same pattern, but its white space may not run over the end of a line."""
    return body.replace(r"\s", r"[^\S\n]")


def for_letters_of(text: Column, regex: str) -> Column:
    """The pattern, with ASCII classes for a text of as many bytes as letters: they match the same there, several times
    faster.  A pattern is compiled again only where the kind of text changes from one row to the next."""
    flags, _, body = regex.removeprefix("(?U").partition(")")
    plain = (f"(?{flags})" if flags else "") + body.replace(WORD, r"\w")
    if not regex.startswith("(?U") or r"\p" in plain:
        return F.lit(regex)
    return F.when(F.octet_length(text) == F.length(text), F.lit(plain)).otherwise(F.lit(regex))


def find_all(text: Column, regex: str, group: int = 1, holding: str | None = None) -> Column:
    """All matches; ``holding`` is a text that stands in each of them, which is cheaper to look for."""
    found = F.regexp_extract_all(text, for_letters_of(text, regex), F.lit(group))
    if holding is None:
        return found
    return F.when(~F.contains(text, F.lit(holding)), F.array().cast("array<string>")).otherwise(found)


def extract(text: Column, regex: str, group: int) -> Column:
    """Group of the first match; ``''`` where nothing matches."""
    return F.call_function("regexp_extract", text, for_letters_of(text, regex), F.lit(group))


def find_fields(text: Column, regex: str, holding: str | None = None, **groups: int) -> Column:
    """ARRAY<STRUCT<name: string, ...>>, one element per match, one field per named group."""
    arrays = [find_all(text, regex, g, holding).alias(name) for name, g in groups.items()]
    return F.arrays_zip(*arrays)


def first_match(text: Column, regex: str, group: int = 1) -> Column:
    """Group of the first match; NULL (not ``''``) where nothing matches."""
    return F.when(F.rlike(text, F.lit(regex)), F.regexp_extract(text, regex, group))


def any_word(text: Column, words: list[str]) -> Column:
    """True where the text contains at least one of a fixed list of words."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def literal_map(table: dict[str, str]) -> Column:
    """A fixed lookup table as one constant MAP, so that a lookup needs no join."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def words(text: Column) -> Column:
    """All maximal runs of word characters."""
    return find_all(text, WORD + "+", 0)


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def sanitize_id(name: Column) -> Column:
    """Diagram node id: ``. - / [ ] ( )`` and blank become ``_``, ``+`` becomes ``_plus_``."""
    return F.replace(F.translate(name, ".-/[]() ", "________"), F.lit("+"), F.lit("_plus_"))


def sanitize_label(name: Column) -> Column:
    """Diagram label without bracket characters."""
    return F.translate(name, "[](){}<>", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def _in_blocks(items: Column) -> Column:
    """An array as about as many blocks as a block has items."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    last = F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, size))


def before_each(sizes: Column) -> Column:
    """For an array of numbers, the sum of those before each.

    An array grows by copying, so one pass over n items copies n * n / 2 of them; blocks as many as
    long copy n times the square root of n.
    """
    def sums(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0).cast("bigint")), sums))

    return bound(F.transform(sizes, lambda x: x.cast("bigint")), lambda all_: bound(_in_blocks(all_), joined))


def first_of_name(items: Column) -> Column:
    """Structs without those whose ``name`` stands before, in order: by sorting, not by comparing all with all."""
    def kept(named: Column) -> Column:
        return F.array_sort(F.filter(named, lambda x, i: (i == 0) | (F.get(named, i - 1)["name"] != x["name"])),
                            lambda x, y: x["at"] - y["at"])

    return bound(items, lambda all_: F.transform(
        bound(F.array_sort(F.transform(all_, lambda x, i: F.struct(x["name"].alias("name"), i.alias("at")))), kept),
        lambda x: F.get(all_, x["at"])))
