"""Cleaning and normalising French text: every function takes and returns Columns and stays in built-in functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from municipia.functions import constants as K


def let(value: Column, body) -> Column:
    """body(value), value being computed once a row; lambdas would otherwise hold its expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column, characters: str = r"\s") -> Column:
    return F.regexp_replace(text, rf"(?U)^[{characters}]+|[{characters}]+$", "")


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Precomposed letters that decompose to one base character and marks, and those bases."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212B]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    plain = lambda t: F.length(t) == F.octet_length(t)
    bare = let(F.translate(text, *_accented()), lambda t: F.when(plain(t), t).otherwise(F.regexp_replace(t, r"\p{Mn}+", "")))
    return F.when(plain(text), text).otherwise(bare)


def norm(text: Column) -> Column:
    """Lower case, no accents, everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def without_leading_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\b0+(\d)", "$1")


def clean_ocr(text: Column) -> Column:
    for pattern, replacement in K.OCR_REPAIRS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def anonymize(text: Column) -> Column:
    """Titles with the capitalised words behind them become "un particulier"."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"(?U){K.PERSON}", "un particulier"), r"(?U)\s{2,}", " "))


def remove_postal_addresses(text: Column) -> Column:
    """Drop applicants' addresses; one that stands right behind "au", "du", "droit du" or "niveau du" is a place and stays."""
    plain = F.regexp_replace(one_line(text), K.DOMICILE, " ")
    kept = rf"(?iu)((?:droit du|niveau du|\bau|\bdu)\s*{K.POSTAL})|{K.POSTAL}"
    return F.regexp_replace(plain, kept, "$1 ")


def search_key(text: Column) -> Column:
    """As typed into a search: no accents, no case, punctuation kept."""
    return F.lower(strip_accents(text))


def matches_all_words(haystack: Column, query: str) -> Column:
    words = [w for w in query.split() if w]
    hay = search_key(haystack)
    found = F.lit(True)
    for w in words:
        found = found & hay.contains(search_key(F.lit(w)))
    return found


#: Private characters that stand around matches; a text's own become blanks.
OPEN, SHUT = "\ue000", "\ue001"


def unmarked(text: Column) -> Column:
    return F.when(text.contains(OPEN) | text.contains(SHUT), F.translate(text, OPEN + SHUT, "  ")).otherwise(text)


def positioned(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, offsets from 0."""
    parts = F.split(F.regexp_replace(unmarked(text), pattern, f"{OPEN}$0{OPEN}"), OPEN)
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["p"])
        here = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x["p"].alias("found")))
        return F.struct(end.alias("at"), F.when(x["i"] % 2 == 1, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(placed, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
