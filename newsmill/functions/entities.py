"""HTML character references decoded as browsers and the standard library do, in built-in functions.

The names and the old meanings of low numbers are read from the standard library on the driver and sent with the plan; the pattern of a
reference and the rule of the longest known beginning are those of HTML.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference: decimal, hexadecimal, or up to 32 characters that may hold a name.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Looked for first, as nearly all references are one of them.
COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "hellip;")


def _map(pairs: dict) -> Column:
    """A constant map, read from one text when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _names(s: Column) -> Column:
    """What a name stands for; the longest beginning that needs no semicolon and the rest; or null."""
    every = html.entities.html5
    bare = {k: v for k, v in every.items() if not k.endswith(";")}
    found = [F.try_element_at(_map({k: every[k] for k in COMMON}), s), F.when(s.rlike("^[A-Za-z][A-Za-z0-9]*;?$"), F.try_element_at(_map(every), s))]
    for n in range(max(map(len, bare)), 1, -1):
        part = {k: v for k, v in bare.items() if len(k) == n}
        if part:
            found.append(F.when(F.char_length(s) > n, F.concat(F.try_element_at(_map(part), F.substring(s, 1, n)), F.substr(s, F.lit(n + 1)))))
    return F.coalesce(*found)


def _low() -> dict[int, str]:
    """What numbers up to 159 mean that don't mean their character: code page 1252, zero and the carriage return."""
    out = {0: "�", 13: "\r"}
    for n in range(128, 160):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def _numbers(s: Column) -> Column:
    """The character of #123; or #x7B; : U+FFFD for what is none, nothing for those that may not stand in a text."""
    digits = F.regexp_extract(s, "^#[xX]?0*([0-9a-fA-F]*);?$", 1)
    hexadecimal = s.rlike("^#[xX]")
    small = F.when(digits == "", F.lit("0")).otherwise(digits)
    n = F.when(F.length(digits) > 7, F.lit(0x110000)).when(hexadecimal, F.conv(small, 16, 10).try_cast("int")).otherwise(small.try_cast("int"))
    unfit = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    known = F.try_element_at(_map(_low()), n.cast("string"))
    return F.when(known.isNotNull(), known).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(unfit, "").otherwise(char)


def unescape(c: Column) -> Column:
    """All references decoded in one pass, so that ``&amp;lt;`` becomes ``&lt;``; what names nothing stays."""

    def one(s: Column) -> Column:
        return F.when(s.startswith("#"), _numbers(s)).otherwise(F.coalesce(_names(s), F.concat(F.lit("&"), s)))

    pieces = F.split(c, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), one)
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), found.alias("f")), lambda z: F.concat(z["p"], F.coalesce(z["f"], F.lit("")))), "")
    return F.when(c.contains("&"), joined).otherwise(c)
