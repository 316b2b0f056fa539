"""Text normalisation and number reading as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.numeric import col

# What the answer texts may contain.
DROPPED = r"[^\p{L}\p{N}_.%/-]+"
LITERAL_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"
INTENDED_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?(?:[kmb]\b|%)?"
SUFFIXES = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}
EDGE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


#: Korean syllables and the letters that they are made of, each in three places.
FIRST_SYLLABLE, LAST_SYLLABLE = 0xAC00, 0xD7A3
LEADS, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7
VOWEL_COUNT, TAIL_COUNT = 21, 28


def compatible_forms() -> tuple[dict[str, str], dict[str, str], list[int]]:
    """Characters with a compatibility form without marks, by its length: one character, or more; and those that leave nothing.

    Letters with marks, wide and styled forms, superscripts; ligatures, fractions, signs for
    words. Korean syllables follow a rule of their own.
    """
    single, longer, gone = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        own = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFKD", own) if not unicodedata.combining(c))
        if not bare:
            gone.append(code)
        elif bare != own and not FIRST_SYLLABLE <= code <= LAST_SYLLABLE:
            (single if len(bare) == 1 else longer)[own] = bare
    return single, longer, gone


def character_class(codes: list[int]) -> str:
    """Class of the code points as ranges, behind one comparison that characters below the first one fail."""
    ends: list[list[int]] = []
    for code in sorted(codes):
        if ends and code == ends[-1][1] + 1:
            ends[-1][1] = code
        else:
            ends.append([code, code])
    parts = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ends)
    return rf"[\x{{{ends[0][0]:X}}}-\x{{10FFFF}}&&[{parts}]]"


SINGLE, LONGER, GONE = compatible_forms()
MARKED, BARE = "".join(SINGLE), "".join(SINGLE.values())
#: Those of Latin-1 apart, so that its letters are not compared with the ranges of all others.
WIDE = [ord(c) for c in LONGER if ord(c) > 0xFF] + list(range(FIRST_SYLLABLE, LAST_SYLLABLE + 1))
ANY_LONGER = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in LONGER if ord(c) <= 0xFF) + character_class(WIDE) + "]"
ANY_GONE = character_class(GONE)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def letters(syllable: Column) -> Column:
    """The letters of a Korean syllable, by arithmetic on its place."""
    place = F.ascii(syllable) - FIRST_SYLLABLE  # the code point
    lead = F.hex(LEADS + F.floor(place / (VOWEL_COUNT * TAIL_COUNT)))
    vowel = F.hex(VOWELS + F.floor(place % (VOWEL_COUNT * TAIL_COUNT) / TAIL_COUNT))
    tail = F.when(place % TAIL_COUNT > 0, F.hex(TAILS + place % TAIL_COUNT)).otherwise("")
    return F.decode(F.unhex(F.concat(lead, vowel, tail)), "UTF-16BE")


def spelled_out(text: Column) -> Column:
    """Text with the characters that stand for several written out, in one pass over its pieces."""
    forms = F.map_from_arrays(F.split(F.lit("\x01".join(LONGER)), "\x01"), F.split(F.lit("\x01".join(LONGER.values())), "\x01"))
    pieces = F.regexp_extract_all(text, F.lit(f"{ANY_LONGER}|[^{ANY_LONGER}]+"), F.lit(0))

    def spelled(piece: Column) -> Column:
        syllable = piece.between(chr(FIRST_SYLLABLE), chr(LAST_SYLLABLE))
        return F.when(F.length(piece) > 1, piece).when(syllable, letters(piece)).otherwise(F.coalesce(F.try_element_at(forms, piece), piece))

    return F.array_join(F.transform(pieces, spelled), "")


def strip_accents(text: Column | str) -> Column:
    """Compatibility decomposition without combining marks, of every character."""
    text = col(text)
    whole = F.when(text.rlike(ANY_LONGER), spelled_out(text)).otherwise(text)
    bare = F.translate(whole, MARKED, BARE)
    folded = F.when(bare.rlike(ANY_GONE), F.regexp_replace(bare, f"{ANY_GONE}+", "")).otherwise(bare)
    # Plain ASCII text has as many bytes as characters.
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def fold(text: Column | str) -> Column:
    return F.lower(strip_accents(text))


def normalized(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, DROPPED, " "))


def normalize_text(text: Column | str) -> Column:
    """Accent-free lower case; only . % / - survive as punctuation; single spaces."""
    return normalized(fold(text))


def read_number(token: Column) -> Column:
    """Value of one matched token: commas dropped, k/m/b multiplied, % left as is."""
    digits = F.regexp_replace(token, "[,%kmb]", "").cast("double")
    scale = F.lit(1.0)
    for letter, factor in SUFFIXES.items():
        scale = F.when(token.endswith(letter), F.lit(factor)).otherwise(scale)
    return digits * scale


def number_tokens(text: Column | str, intended: bool = True) -> Column:
    """Matched number texts.

    The literal rule reads normalised text, so commas split numbers and k/m/b is
    never seen; the intended rule reads the text before punctuation is dropped.
    """
    return folded_tokens(fold(text), intended)


def folded_tokens(folded: Column, intended: bool = True) -> Column:
    if not intended:
        return F.regexp_extract_all(normalized(folded), F.lit(LITERAL_NUMBER), F.lit(0))
    return F.regexp_extract_all(F.replace(folded, F.lit("$"), F.lit("")), F.lit(INTENDED_NUMBER), F.lit(0))


def readings(tokens: Column) -> Column:
    """All values of the tokens; a percentage is also read as a fraction."""

    def both(token: Column) -> Column:
        value = read_number(token)
        return F.when(token.endswith("%"), F.array(value, value / 100.0)).otherwise(F.array(value))

    return F.flatten(F.transform(tokens, both))


def extract_numbers(text: Column | str, intended: bool = True) -> Column:
    return readings(number_tokens(text, intended))


def compare_numeric(expected: Column | str, actual: Column | str, rel_tol: float = 0.01, intended: bool = True) -> Column:
    """True or false when one expected number can be compared, else NULL."""
    return compare_folded(fold(expected), fold(actual), rel_tol, intended)


def compare_folded(expected: Column, actual: Column, rel_tol: float = 0.01, intended: bool = True) -> Column:
    """The same of folded texts. Numbers and their values are read once per row."""
    tokens = F.struct(folded_tokens(expected, intended).alias("want"), folded_tokens(actual, intended).alias("got"))

    def distinct(of: Column) -> Column:
        return F.array_distinct(F.transform(of, read_number) if intended else readings(of))

    def read(t: Column) -> Column:
        return F.struct(
            F.array_distinct(readings(t["want"])).alias("want"), F.array_distinct(readings(t["got"])).alias("got"),
            F.size(distinct(t["want"])).alias("wanted"), F.size(distinct(t["got"])).alias("given"),
        )

    def verdict(v: Column) -> Column:
        def near(value: Column) -> Column:
            return F.exists(v["want"], lambda e: F.abs(value - e) <= F.greatest(F.abs(e) * rel_tol, F.lit(rel_tol)))

        return (
            F.when((v["wanted"] != 1) | (F.size(v["got"]) == 0), F.lit(None).cast("boolean"))
            .when(F.exists(v["got"], near), F.lit(True))
            .when(v["given"] == 1, F.lit(False))
        )

    return bound(bound(tokens, read), verdict)


def strip_space(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(col(text), F.lit(EDGE_SPACE))


def format_scalar(value: Column, kind: str) -> Column:
    """Result cell as text: whole doubles without point, others with six digits at most."""
    if kind not in ("double", "float"):
        return F.coalesce(value.cast("string"), F.lit("null"))
    nearest = F.round(value)
    whole = F.abs(value - nearest) <= 1e-9 * F.greatest(F.abs(value), F.abs(nearest))
    digits = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    return F.coalesce(F.when(whole, nearest.try_cast("long").cast("string")), digits, F.lit("null"))
