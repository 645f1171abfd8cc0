"""Normalisation of names and addresses, and the keys that records are retrieved by."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vocabulary import ABBREVIATIONS, NAME_STOPWORDS


def _combining_class() -> str:
    """A regex class of the characters with a combining class other than 0. \\p{M} is another set."""
    marks = [c for c in range(0x300, min(sys.maxunicode, 0x1FFFF)) if unicodedata.combining(chr(c))]
    parts, start = [], None
    for c, after in zip(marks, [*marks[1:], None], strict=True):
        start = c if start is None else start
        if after != c + 1:
            parts.append(rf"\x{{{start:X}}}-\x{{{c:X}}}")
            start = None
    return f"[{''.join(parts)}]"


_MARKS = _combining_class()


def _unmarked(text: pa.Array) -> pa.Array:
    """Decomposed, without combining marks. A class of so many ranges is one automaton here; in Java each character is held against each range."""
    plain = pc.string_is_ascii(text)
    if pc.all(plain, min_count=0).as_py():
        return text
    others = text.filter(pc.invert(plain))
    return pc.replace_with_mask(text, pc.fill_null(pc.invert(plain), False), pc.replace_substring_regex(pc.utf8_normalize(others, "NFKD"), _MARKS, ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression that stands several times in another is computed as often, inside lambdas at least."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def looked_up(word: Column, table: Mapping[str, str]) -> Column:
    """What table has for the word, or null. The set is hashed; the map, which is not, is asked for words that it has."""
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.when(word.isin(*table), F.try_element_at(known, word))


def strip_accents(text: Column) -> Column:
    """Decomposed, without combining marks."""
    return F.arrow_udf(_unmarked, StringType())(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Words of a text by single spaces; none of the empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def replaced(words: Column, table: Mapping[str, str]) -> Column:
    return F.transform(words, lambda t: F.coalesce(looked_up(t, table), t))


def clean(text: Column) -> Column:
    """Lower case without accents and apostrophes; all but letters and digits are spaces."""
    low = F.replace(F.replace(F.lower(strip_accents(text)), F.lit("'")), F.lit("’"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def expanded(cleaned: Column, table: Mapping[str, str] = ABBREVIATIONS) -> Column:
    return F.array_join(replaced(tokens(cleaned), table), " ")


def normalize(text: Column) -> Column:
    return expanded(clean(text))


def core_name(normalized: Column, stop: list[str] = NAME_STOPWORDS) -> Column:
    return F.array_join(F.filter(tokens(normalized), lambda t: ~t.isin(*stop)), " ")


def number_tokens(normalized: Column) -> Column:
    """Distinct digit runs in string order."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(normalized, F.lit(r"(\p{Nd}+)"), 1))), " ")


def _ascii_digits() -> tuple[str, str]:
    found = [chr(c) for c in range(0x80, 0x1FFFF) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def first_number(normalized: Column) -> Column:
    """The first digit run, of its first 15 digits; -1 if there is none."""
    run = F.substring(F.regexp_extract(normalized, r"(\p{Nd}+)", 1), 1, 15)
    return F.coalesce(F.translate(run, *_ascii_digits()).try_cast("long"), F.lit(-1).cast("long"))


def non_ascii_share(text: Column) -> Column:
    whole = F.length(F.coalesce(text, F.lit("")))
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / whole)


def token_count(normalized: Column) -> Column:
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " ")))


def country_label(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))


def _with_bigrams(words: Column, one: str, two: str) -> Column:
    def keys(words: Column) -> Column:
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit(two), a, F.lit("_"), b))
        return F.concat(F.transform(words, lambda t: F.concat(F.lit(one), t)), F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))

    return let(words, keys)


def name_keys(core: Column) -> Column:
    """n: words of two letters at least, nb: pairs of neighbours among them."""
    return _with_bigrams(F.filter(tokens(core), lambda t: F.length(t) > 1), "n:", "nb:")


def address_keys(normalized: Column) -> Column:
    """a: words of two letters at least or of digits, ab: pairs of neighbours among them."""
    return _with_bigrams(F.filter(tokens(normalized), lambda t: (F.length(t) > 1) | t.rlike(r"^\p{Nd}+$")), "a:", "ab:")


def held_out(entity_id: Column) -> Column:
    """A stable tenth of the entities."""
    return F.crc32(entity_id.cast("binary")) % 10 == 0
