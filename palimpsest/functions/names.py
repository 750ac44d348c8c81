"""Names and characters as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the WinAnsi codes 0x80 to 0x9F that have one.
WIN_ANSI_HIGH = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
#: Substitute families where a family is not installed.
SUBSTITUTES = {"Times New Roman": "Liberation Serif", "Arial": "Liberation Sans", "Helvetica": "Liberation Sans", "Courier": "Liberation Mono"}

#: Characters of the glyph names that are words.
GLYPH_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
}


def glyph_name_code_point(name: str) -> int | None:
    """Code point of a glyph name: a word, a character, or uniXXXX."""
    spelled = GLYPH_NAMES.get(name, name if len(name) == 1 else None)
    if spelled is None and re.fullmatch("uni[0-9A-Fa-f]{4}", name):
        spelled = chr(int(name[3:], 16))
    return None if spelled is None or "\ud800" <= spelled <= "\udfff" else ord(spelled)


def glyph_name(name: Column) -> Column:
    """The character of a glyph name, as a Column; NULL where it has none."""
    words = F.create_map(*[F.lit(x) for pair in GLYPH_NAMES.items() for x in pair])
    point = F.conv(F.substring(name, 4, 4), 16, 10).cast("bigint")
    coded = F.when(name.rlike("^uni[0-9A-Fa-f]{4}$") & ~point.between(0xD800, 0xDFFF), F.decode(F.unhex(F.substring(name, 4, 4)), "UTF-16BE"))
    return F.coalesce(words[name], F.when(F.length(name) == 1, name), coded)


def win_ansi_code_point(code: int) -> int | None:
    if 0x20 <= code <= 0x7E or 0xA0 <= code <= 0xFF:
        return code
    return WIN_ANSI_HIGH.get(code)


def ps_name(name: Column) -> Column:
    """struct(family, bold, italic) of a PostScript font name."""
    core = F.regexp_replace(name, "(MT)+$", "")
    style = F.regexp_extract(core, "-(BoldItalic|Bold|Italic|Oblique)$", 1)
    family = F.regexp_replace(F.regexp_replace(core, "-(BoldItalic|Bold|Italic|Oblique)$", ""), "(PS)+$", "")
    spaced = F.regexp_replace(family, "(?<!^)([A-Z])", " $1")
    return F.struct(
        spaced.alias("family"), style.isin("BoldItalic", "Bold").alias("bold"), style.isin("BoldItalic", "Italic", "Oblique").alias("italic")
    )


def pdf_name(name: Column) -> Column:
    """A name with every byte outside ! to ~, and every delimiter, as #XX."""
    return _escaped(name, "#", r"[!-~&&[^#%()/<>\[\]{}]]")


def file_name(name: Column) -> Column:
    """A name safe for a file: all but letters, digits, _ and - as %XX."""
    return _escaped(name, "%", "[A-Za-z0-9_-]")


def _escaped(name: Column, mark: str, plain: str) -> Column:
    size = F.octet_length(name)
    data = F.hex(name.cast("binary"))
    pairs = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substr(data, i * 2 + 1, F.lit(2)))
    char = lambda h: F.decode(F.unhex(h), "ISO-8859-1")
    out = F.transform(pairs, lambda h: F.when(char(h).rlike(f"^{plain}$"), char(h)).otherwise(F.concat(F.lit(mark), h)))
    return F.when(size == 0, "").otherwise(F.array_join(out, ""))


def number(v: Column) -> Column:
    """A number with at most four decimals, no trailing zeros, no minus zero."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v.cast("double")), "0+$", ""), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)
