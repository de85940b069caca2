"""Column helpers that keep the value rules of the library in one place.

Empty and zero count as missing where a rule says "or"; ties go to the earliest row; text is stripped of all white
space, not only spaces; numbers in text that don't parse and divisions by zero give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_filled(*xs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def first_nonzero(*xs: Column) -> Column:
    """The first number that is neither null nor zero."""
    return F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in xs])


def number(x: Column) -> Column:
    """A number in text, with or without thousands commas; null if it doesn't parse."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def percent_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def day(x: Column) -> Column:
    return F.to_date(x)


def lines(text: Column) -> Column:
    """Lines of a text, with carriage returns treated as line ends."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1)


def clipped(x: Column, most: int, mark: str) -> Column:
    """At most ``most`` characters; a longer text loses its end to the mark."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - len(mark)), F.lit(mark))).otherwise(x)


def json_text(x: Column) -> Column:
    """A text as a JSON string with only the escapes that JSON needs; null as ``null``."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with sorted keys, ``", "`` and ``": "`` between its parts."""
    parts = [F.concat(F.lit(f'"{name}": '), json_text(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def canonical_json_map(entries: Column) -> Column:
    """The same for a map of texts, whatever the order of its entries."""
    sorted_entries = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_entries, lambda e: F.concat(json_text(e.key), F.lit(": "), json_text(e.value))), ", "), F.lit("}"))


def short_digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(x, 256), 1, 16))
