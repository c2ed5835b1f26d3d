"""Helpers shared by the column functions: whitespace, words and term tests."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware stand-ins for \w and \s. The white-space property is one lookup
# per character, where a list of code points would be tested one by one.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def alternation(terms: Iterable[str]) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms)


def contains_any(text: Column | str, tokens: Iterable[str]) -> Column:
    """Plain substring test against a closed list, as one pass over the text."""
    return as_col(text).rlike(alternation(tokens))


def has_term(text: Column | str, terms: Iterable[str]) -> Column:
    """True where one of the terms stands alone in an already lower-cased text."""
    return as_col(text).rlike(rf"(?<![a-z0-9_])(?:{alternation(terms)})(?![a-z0-9_])")


def find_all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(group))


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern, NULL where there is none."""
    return F.nullif(F.regexp_extract(as_col(text), pattern, group), F.lit(""))


def sorted_set(array: Column, limit: int | None = None) -> Column:
    ordered = F.array_sort(F.array_distinct(array))
    return ordered if limit is None else F.slice(ordered, 1, limit)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), rf"{SPACE}+\z", "")


def words(text: Column | str) -> Column:
    """Whitespace-separated words, without empties."""
    return F.array_remove(F.split(as_col(text), f"{SPACE}+"), "")


def split_lines(text: Column | str) -> Column:
    """Lines at any line break; a final break opens no extra line."""
    body = F.regexp_replace(as_col(text), rf"(?:{LINE_BREAK})\z", "")
    return F.when(F.length(as_col(text)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK)
    )


def newline_lines(text: Column | str) -> Column:
    """Lines at newlines only; keeps a last empty line."""
    return F.split(as_col(text), "\n")


def first_of(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """First rule whose condition holds; a CASE built from (condition, value) pairs."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def flagged(pairs: Iterable[tuple[Column, object]]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    items = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    return F.array_compact(F.array(*items))


def lookup(key: Column, table: dict[str, object]) -> Column:
    """Value for a key of a closed vocabulary, NULL where absent."""
    cells = []
    for k, v in table.items():
        cells += [F.lit(k), strings(v) if isinstance(v, tuple) else F.lit(v)]
    return F.try_element_at(F.create_map(*cells), key)


def let(value: Column, body) -> Column:
    """Bind an expression to a name so that it is computed once per row.

    A column used inside a lambda is evaluated again for every element. Here it
    becomes the start value of a fold over nothing, and the finish step sees it
    as a variable: neither copied nor typed again at run time.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda acc, _: acc, body)
