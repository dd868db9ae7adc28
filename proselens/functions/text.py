"""Text helpers with Python ``str`` semantics, as native Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/split() use any Unicode whitespace; Java's \s is ASCII
# unless the (?U) flag is set.
_WS = r"(?U)\s"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: trim any Unicode whitespace at both ends."""
    return F.regexp_replace(col_(c), rf"{_WS}+$|^{_WS}+", "")


def py_split(c) -> Column:
    """``str.split()``: split on runs of whitespace, no empty tokens."""
    return F.array_remove(F.split(col_(c), rf"{_WS}+"), "")


def word_tokens(c) -> Column:
    """``text.lower().split()``; NULL text gives no tokens."""
    return py_split(F.lower(F.coalesce(col_(c), F.lit(""))))


def spaced_words(c) -> Column:
    """The words of ``word_tokens`` with a blank between them, and perhaps one
    at either end."""
    return F.regexp_replace(F.lower(F.coalesce(col_(c), F.lit(""))), rf"{_WS}+", " ")


def nonblank_lines(c) -> Column:
    """Lines of a text, each stripped, empty ones dropped; NULL -> []."""
    # one pass: white space around a line break goes with it, blank lines too
    return F.array_remove(F.split(py_strip(F.coalesce(col_(c), F.lit(""))), rf"{_WS}*\n{_WS}*"), "")


def contains_any(c, words: Iterable[str]) -> Column:
    """Case-insensitive substring test against several keywords."""
    low = F.lower(F.coalesce(col_(c), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def display_name(c) -> Column:
    """``reason.replace('_', ' ').title()``."""
    return F.initcap(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def fixed(c, digits: int) -> Column:
    """``f"{x:.Nf}"`` (half-even on the binary value, no grouping)."""
    return F.replace(F.format_number(col_(c), digits), F.lit(","), F.lit(""))


def render_template(template, values: dict) -> Column:
    """Literal replacement of ``{name}`` placeholders, in the given order.

    Placeholders that are not in ``values`` stay as they are, as do doubled
    braces; this is plain ``str.replace``, not ``str.format``.
    """
    out = col_(template) if not isinstance(template, str) else F.lit(template)
    for key, val in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(col_(val).cast("string"), F.lit("")))
    return out


def list_text(c) -> Column:
    """A list rendered as text (JSON form)."""
    return F.to_json(col_(c))


def excerpt(c, n: int = 150) -> Column:
    return F.substring(col_(c), 1, n)
