"""Cleaning of text columns: Column -> Column, built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_list(c: Column | str, delimiter: str = r",\s+") -> Column:
    """Items of a delimited list, trimmed, empty ones dropped.

    A comma without a blank belongs to the item: chemical names are full of them.
    """
    items = F.transform(F.split(_col(c), delimiter), lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "")


def strip_literal(c: Column | str) -> Column:
    """Text of a printed list without the brackets and quotes at its ends."""
    return F.btrim(_col(c), F.lit("[]'"))


def literal_items(c: Column | str) -> Column:
    """Items of a printed list such as `['A', 'B']`; the items hold no blanks."""
    return F.regexp_extract_all(_col(c), F.lit(r"[^\[\]', ]+"), F.lit(0))


def quoted_items(c: Column | str) -> Column:
    """Items of a printed list whose items may hold blanks and commas: quotes around a comma separate them."""
    items = F.split(F.btrim(_col(c), F.lit("[]'\"")), "['\"]\\s*,\\s*['\"]")
    return F.filter(F.transform(items, lambda item: F.trim(item)), lambda item: item != "")


def redelimit(c: Column | str, delimiter: str = "|") -> Column:
    """A printed list as plain text: quotes and brackets go, `, ` becomes `delimiter`."""
    return F.replace(F.translate(_col(c), "\"'[]", ""), F.lit(", "), F.lit(delimiter))


def join_list(c: Column | str, delimiter: str = ", ") -> Column:
    """Flat text of an array, for export; null stays null."""
    return F.array_join(_col(c), delimiter)


def drop_vague(c: Column | str, term: str, delimiter: str = "|") -> Column:
    """Remove `term` from a delimited list that has other members; alone, it stays."""
    text = _col(c)
    others = F.array_remove(F.split(text, rf"\{delimiter}"), term)
    return F.when(
        text.contains(delimiter) & (F.size(others) > 0), F.array_join(others, delimiter)
    ).when(text.contains(delimiter), F.lit(term)).otherwise(text)


def empty_to_null(c: Column | str) -> Column:
    """An empty array carries no information: null instead."""
    return F.when(F.size(_col(c)) > 0, _col(c))


def differs(c: Column | str, value) -> Column:
    """Not equal, where null differs from any value."""
    return ~_col(c).eqNullSafe(F.lit(value))


def trimmed_id(c: Column | str) -> Column:
    """A join key as text without surrounding blanks."""
    return F.trim(_col(c).cast("string"))


def map_values(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace whole values found in a short fixed mapping, keep all others."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(c)), _col(c))


def term_key(c: Column | str) -> Column:
    """The form under which disease terms are compared."""
    return F.lower(F.trim(_col(c)))


def control_class(c: Column | str) -> Column:
    """`name` for a named control, `keyword` for a keyword, `none` when nothing was found."""
    c = _col(c)
    return (
        F.when(c.isNull(), "none").when(c.startswith("C"), "name").when(c.startswith("K"), "keyword")
    )


def split_items(column: str | Column, delimiter: str) -> Column:
    """The items between the delimiters, as they are; the delimiter is plain text."""
    return F.split(column, re.escape(delimiter))
