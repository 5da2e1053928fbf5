"""Character references of HTML, decoded in one scan.

A text is cut where references stand; each is looked up by itself and put back,
so that what a reference gives is never read as another. The names are those of
Python's own table; the rest follows from rules.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that count without a semicolon too, the longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numbers that stand for another character: those of Windows' code page.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _table(pairs: dict) -> Column:
    """A map that is a constant of the plan."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(number: Column) -> Column:
    """Of a code point: none for what isn't a character, the replacement for what can't be one."""
    hexed = F.lpad(F.hex(number), 8, "0")
    noncharacter = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "�").when(number.between(0x80, 0x9F), F.try_element_at(_table(_WINDOWS), number.cast("string")))
        .when(control | noncharacter, "").otherwise(F.decode(F.unhex(hexed), "UTF-32"))
    )


def _decoded(reference: Column) -> Column:
    body = F.substring(reference, 2, 64)
    digits = F.regexp_replace(F.regexp_replace(body, r"^#[xX]?0*|;$", ""), r"^$", "0")
    hexadecimal = body.rlike(r"^#[xX]")
    number = F.when(F.length(digits) > 8, F.lit(0x110000)).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(F.when(hexadecimal, "0").otherwise(digits).cast("long"))
    bare = F.regexp_extract(body, "^(?:" + "|".join(_BARE) + ")", 0)
    named = F.coalesce(F.try_element_at(_table(html5), body), F.when(bare != "", F.concat(F.try_element_at(_table({n: html5[n] for n in _BARE}), bare), F.substring(body, F.length(bare) + 1, F.length(body)))))
    return F.when(body.startswith("#"), _character(number)).otherwise(F.coalesce(named, reference))


def unescape(text: Column) -> Column:
    """Numeric and named references as the characters that they stand for; what is none stays. Null stays null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _decoded)
    rest = F.split(text, REFERENCE, -1)
    return F.when(text.contains("&"), F.array_join(F.zip_with(F.concat(F.array(F.lit("")), found), rest, lambda a, b: F.concat(a, b)), "")).otherwise(text)
