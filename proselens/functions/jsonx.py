"""Tolerant JSON reading of model replies (native expressions, no UDF).

``parse_json_tolerant(raw)`` repairs a reply the way a forgiving reader would:

1. NULL or empty reply -> NULL.
2. Take the span from the first ``{`` to the last ``}`` (dot matches newline);
   without such a span, the stripped text.
3. If the text has single quotes and no double quotes, turn ``'`` into ``"``.
4. Drop commas before a closing ``}``.
5. Parse.  If that fails and there are more ``{`` than ``}``, append one ``}``
   and parse again.

Parsing uses ``try_parse_json`` on ``'[' || c || ']'`` and keeps element 0
only when there is no element 1, so a text holding two objects is rejected
instead of yielding the first one.  Only JSON objects are accepted.  Known
differences from a Python reader: ``NaN`` literals and duplicate keys give
NULL here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proselens.functions.text import col_, py_strip

_SPAN = r"(?s)\{.*\}"
_TRAILING_COMMA = r"(?U),\s*\}"


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def has_key(v, key: str) -> Column:
    """Key present (a JSON null value still counts as present)."""
    return F.try_variant_get(col_(v), f"$.{key}", "variant").isNotNull()


def get_double(v, key: str) -> Column:
    """Numeric value with try semantics ("1.5" -> 1.5; junk and NaN -> NULL)."""
    return F.nanvl(F.try_variant_get(col_(v), f"$.{key}", "double"), F.lit(None).cast("double"))


def get_string(v, key: str) -> Column:
    return F.try_variant_get(col_(v), f"$.{key}", "string")


def get_bool(v, key: str) -> Column:
    return F.try_variant_get(col_(v), f"$.{key}", "boolean")


# One element of list text: a quoted string (either quote, backslash escapes)
# or a number or constant.
_ELEMENT = (r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|"""
            r"""-?[0-9.][0-9.eE+-]*|None|True|False|null|true|false""")
_LIST = rf"(?s)^\s*[\[(]\s*(?:(?:{_ELEMENT})\s*(?:,\s*|(?=[\])]\s*$)))*[\])]\s*$"


def parse_list_text(c) -> Column:
    """Features stored as list text: each element by its own quotes, else the
    text as a one-element list; '' -> []."""
    t = col_(c)
    quoted = F.regexp_extract_all(t, F.lit(f"(?s){_ELEMENT}"), F.lit(0))
    escape = F.lit("\\\\(.)")

    def plain(x):
        inner = F.when(x.startswith("'") | x.startswith('"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
        return F.regexp_replace(inner, escape, F.lit("$1"))

    return (F.when(t.isNull() | (t == ""), F.array().cast("array<string>"))
            .when(t.rlike(_LIST), F.transform(quoted, plain))
            .otherwise(F.array(t)))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it in ``fn(v)``: ``get(transform(array(value), fn), 0)``.

    The bound value appears once in the expression tree however often
    ``fn`` uses it, so plans stay linear in size even after the optimizer
    substitutes the expression into pushed-down filters.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def _first_object_of(wrapped: Column) -> Column:
    return let(F.try_variant_get(wrapped, "$[0]", "variant"), lambda first: F.when(
        F.try_variant_get(wrapped, "$[1]", "variant").isNull() & F.schema_of_variant(first).startswith("OBJECT"),
        first))


def parse_json_tolerant(raw) -> Column:
    """Steps 1-5 of the module doc as one expression (VARIANT object or
    NULL), every intermediate text bound once (see ``let``)."""
    def from_raw(r):
        def from_span(span):
            def from_c0(c0):
                def from_rep(rep):
                    more_open = _count(rep, "{") > _count(rep, "}")
                    return let(_first_object_of(F.try_parse_json(F.concat(F.lit("["), rep, F.lit("]")))),
                               lambda o1: F.coalesce(o1, F.when(o1.isNull() & more_open, _first_object_of(
                                   F.try_parse_json(F.concat(F.lit("["), rep, F.lit("}]")))))))
                c1 = F.when(c0.contains("'") & ~c0.contains('"'), F.replace(c0, F.lit("'"), F.lit('"'))).otherwise(c0)
                return let(F.when(r.isNotNull() & (r != ""), F.regexp_replace(c1, _TRAILING_COMMA, "}")), from_rep)
            return let(F.when(span != "", span).otherwise(py_strip(r)), from_c0)
        return let(F.regexp_extract(r, _SPAN, 0), from_span)
    return let(col_(raw), from_raw)
