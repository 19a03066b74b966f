"""Scalar and aggregate functions over columns, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def argument_error(arguments: Column, required: list[str]) -> Column:
    """The first check that fails (errors are data), null if none.

    invalid_json, arguments_must_be_object, missing_required, invalid_type
    (a required value is no string), empty_required (a blank one).
    """
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    out = F.when(parsed.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "arguments_must_be_object")
    fields = [(F.try_variant_get(parsed, f"$['{name}']", "string"), F.schema_of_variant(F.try_variant_get(parsed, f"$['{name}']", "variant"))) for name in required]
    for _, kind in fields:
        out = out.when(kind.isNull(), "missing_required")
    for _, kind in fields:
        out = out.when(kind != "STRING", "invalid_type")
    for value, _ in fields:
        out = out.when(F.trim(value) == "", "empty_required")
    return out


def action_fingerprint(name: Column, arguments: Column) -> Column:
    """Name and canonical JSON of the arguments (keys in order, no spaces), so that equal actions are equal; what is no JSON is trimmed.

    A variant writes 1.0 as 1, so numbers that differ in writing alone are one.
    """
    spaces = F.lit(" \t\n\r\x0b\f")
    return F.concat(name, F.lit(":"), F.coalesce(F.to_json(F.try_parse_json(arguments)), F.trim(arguments, spaces)))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors of one length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    sizes = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(F.lit(0.0))


def _letters(*ranges: tuple[int, int]) -> str:
    return "".join(chr(i) for a, b in ranges for i in range(a, b + 1))


#: Letters whose upper case Spark writes as several letters: those with one letter that stands for it, and that letter.
_TITLED = _letters((0x1F80, 0x1F87), (0x1F90, 0x1F97), (0x1FA0, 0x1FA7)) + "ß\u1fb3\u1fc3\u1ff3"
_TITLES = _letters((0x1F88, 0x1F8F), (0x1F98, 0x1F9F), (0x1FA8, 0x1FAF)) + "ẞ\u1fbc\u1fcc\u1ffc"
#: Letters of Unicode 16 and those they belong to, which keep their case.
_NEW = "\u019b\u0264\u1c89\u1c8a\ua7cb\ua7cc\ua7cd\ua7da\ua7db\ua7dc" + _letters((0x10D50, 0x10D65), (0x10D70, 0x10D85))
#: The others whose upper case is several letters; they stay as they are.
_SINGLE = "\u0149\u01f0\u0390\u03b0\u0587\u1f50\u1f52\u1f54\u1f56\u1fb2\u1fb4\u1fb6\u1fb7\u1fc2\u1fc4\u1fc6\u1fc7\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2\u1fe3\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7" + _letters((0x1E96, 0x1E9A), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


def _by_letter(text: str, convert: Callable[[Column], Column], apart: str, become: str) -> Column:
    """``convert`` of all but the letters ``apart``, which become those of ``become``."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{apart}]|[^{apart}]+"), F.lit(0))
    return F.when(F.col(text).rlike(f"[{apart}]"), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{apart}]"), F.translate(p, apart, become)).otherwise(convert(p))), "")).otherwise(convert(F.col(text)))


def upper_letters(text: str) -> Column:
    """Upper case letter by letter, as SQL engines without special casing have it: no letter becomes two (ß becomes ẞ)."""
    return _by_letter(text, F.upper, _TITLED + _TITLES + _SINGLE + _NEW, _TITLES + _TITLES + _SINGLE + _NEW)


def lower_letters(text: str) -> Column:
    """Lower case letter by letter: a Σ at a word's end is σ as elsewhere, and İ is i."""
    return _by_letter(text, F.lower, "Σİ" + _NEW, "σi" + _NEW)


def add_lists(parts: Column, order: Column) -> Column:
    """Aggregate: the lists of a group one after the other in ``order``, as an adding reducer joins what parallel branches return."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("p")))), lambda x: x["p"]))
