"""Version ordering as a native sort key: one string that compares byte by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest value of an unsigned 64-bit number; larger digit runs compare by magnitude (fixed value).
MAX_U64 = "18446744073709551615"

#: White space of Unicode (fixed values) and decimal digits, as sets of characters to trim.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_DIGITS = "0123456789"
#: Marks of the key, in their order: end of a suffix, a part below zero, a zero before such a part, the end, a zero before
#: a part above zero, such a part; and a zero part that is still to be told apart.
_T, _N, _ZN, _END, _ZP, _P, _Z = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def _base(version: Column) -> tuple[Column, Column]:
    """(-1, 0 or 1 for ``< ``, nothing and ``> ``; the text without it and without letters before the first number)."""
    text = _trim(F.coalesce(version, F.lit("")))
    approx = F.when(text.startswith("< "), -1).when(text.startswith("> "), 1).otherwise(0)
    base = F.when(approx != 0, _trim(F.substring(text, F.lit(3), F.length(text)))).otherwise(text)
    return approx, F.regexp_replace(base, r"(?s)^[^0-9.]+(?=[0-9])", "")


def version_parts(version: Column) -> Column:
    """array<struct<number, suffix>> of the dotted parts: digits without leading zeros, suffix in lower case."""
    raw = F.transform(F.split(_base(version)[1], r"\."), _trim)

    def cut(x: Column) -> Column:
        suffix = F.ltrim(x, F.lit(_DIGITS))
        digits = F.substring(x, F.lit(1), F.length(x) - F.length(suffix))
        return F.struct(F.ltrim(digits, F.lit("0")).alias("number"), F.lower(suffix).alias("suffix"), digits.alias("digits"))

    return F.transform(raw, cut)


def _safe(suffix: Column) -> Column:
    """A suffix whose characters are all above the marks, in the same order."""
    out = F.replace(suffix, F.lit("\t"), F.lit("\t\x19"))
    for i in range(9):
        out = F.replace(out, F.lit(chr(i)), F.lit("\t" + chr(16 + i)))
    return F.when(suffix.rlike("[\\x00-\\x09]"), out).otherwise(suffix)


def _item(p: Column) -> Column:
    """A part that is not zero: below zero (0 with a suffix) or above; number by length and digits; no suffix above any."""
    over = (F.length(p["number"]) > 20) | ((F.length(p["number"]) == 20) & (p["number"] > MAX_U64))
    number, rest = F.when(over, MAX_U64).otherwise(p["number"]), F.when(over, p["digits"]).otherwise("")
    value = F.concat(F.lpad(F.length(number).cast("string"), 2, "0"), number, F.lpad(F.length(rest).cast("string"), 6, "0"), rest)
    suffix = F.when(p["suffix"] == "", "1").otherwise(F.concat(F.lit("0"), _safe(p["suffix"])))
    return F.concat(F.when(p["number"] == "", _N).otherwise(_P), value, suffix, F.lit(_T))


def _lone(word: str) -> str:
    return f"{_N}000000000{word}{_T}"


def version_key(version: Column) -> Column:
    """A string that sorts as versions do: use it in orderBy, min, max, comparisons.

    Dotted parts compare as (number, no suffix above any suffix, suffix ignoring case); a shorter version goes on with
    zeros for ever.  Therefore zero parts at the end are left out, and a zero before a part above zero ranks above the
    end, one before a part below zero (0 with a suffix) below it.  A lone ``latest`` is above and a lone ``unknown``
    below all others; ``< 1`` and ``> 1`` lie just beside ``1``.  No key begins another.
    """
    zero = lambda p: (p["number"] == "") & (p["suffix"] == "")
    joined = F.array_join(F.transform(version_parts(version), lambda p: F.when(zero(p), _Z).otherwise(_item(p))), "")

    def key(s: Column) -> Column:
        rank = F.when(s == _lone("latest"), "2").when(s == _lone("unknown"), "0").otherwise("1")
        marked = F.regexp_replace(F.regexp_replace(s, f"{_Z}(?={_Z}*{_P})", _ZP), f"{_Z}(?={_Z}*{_N})", _ZN)
        body = F.when(rank != "1", "").when(F.contains(s, F.lit(_Z)), marked).otherwise(s)
        return F.concat(rank, body, F.lit(_END))

    # a one-element transform binds the parts, so that they are worked out once
    bound = F.get(F.transform(F.array(F.rtrim(joined, F.lit(_Z))), key), 0)
    return F.concat(bound, (_base(version)[0] + 1).cast("string"))


def reverse_key(key: Column) -> Column:
    """A string that sorts against ``key``: as no key begins another, the complement of its bytes does."""
    return F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210")
