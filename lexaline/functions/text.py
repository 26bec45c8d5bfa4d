"""Keys, lengths and order of words, in UTF-16 terms where that is the rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that are stripped. U+00A0, U+2007 and U+202F are not among them.
WHITESPACE = r"[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
PYTHON_WHITESPACE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))


def strip(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def normalize(raw: Column) -> Column:
    """A word's key: white space stripped at both ends, lower case by the root locale's rules."""
    return F.lower(strip(raw))


def is_blank(raw: Column) -> Column:
    return strip(raw) == ""


def has_astral(word: Column) -> Column:
    """Whether a word has characters of two UTF-16 units."""
    return word.rlike(r"[\x{10000}-\x{10FFFF}]")


def units(word: Column) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.octet_length(F.encode(word, "UTF-16BE")) / 2).cast("int")


def unit_order(word: Column) -> Column:
    """What orders words by UTF-16 units."""
    return F.encode(word, "UTF-16BE")


def highlight(word: Column, query: Column) -> Column:
    """The part of a display word that matched a prefix, as long as the stripped query, and the rest; no part if it doesn't start so."""
    key = normalize(query)
    head = F.when((key != "") & F.lower(word).startswith(key), F.substring(word, F.lit(1), F.length(strip(query)))).otherwise("")
    return F.struct(head.alias("head"), F.substring(word, F.length(head) + 1, F.length(word)).alias("tail"))


def _fixed(number: Column, places: int) -> Column:
    """A number with so many decimals and no grouping."""
    return F.regexp_replace(F.format_number(number, places), ",", "")


def micros_label(micros: Column) -> Column:
    """Microseconds for reading: milliseconds from 1,000 on, decimals where they are few."""
    text = F.when(micros >= 1000, F.concat(_fixed(micros / 1000, 2), F.lit(" ms"))).when(micros >= 10, F.concat(_fixed(micros, 0), F.lit(" µs")))
    return F.when(micros.isNull(), "—").otherwise(F.coalesce(text, F.concat(_fixed(micros, 2), F.lit(" µs"))))


def speedup_label(speedup: Column) -> Column:
    """A ratio for reading, with two decimals, one from 10 on and none from 100 on; a dash for what isn't finite."""
    text = F.when(speedup >= 100, _fixed(speedup, 0)).when(speedup >= 10, _fixed(speedup, 1)).otherwise(_fixed(speedup, 2))
    bad = speedup.isNull() | F.isnan(speedup) | (F.abs(speedup) == float("inf"))
    return F.when(bad, "—").otherwise(F.concat(text, F.lit("×")))


def count_label(n: Column) -> Column:
    """A count with its thousands grouped."""
    return F.format_number(n, 0)
