"""Several values packed in one field, split into one value per row.

A parsing expression grammar with ordered alternatives reads a field::

    field     <- value (separator value)* end
    value     <- blank* (quoted / bracketed / bare) blank*
    quoted    <- mark (mark mark / [^mark])* mark &(blank* (separator / end))
    bracketed <- '[' balanced ']' &(blank* (separator / end))
    bare      <- (!separator .)*
    separator <- ',' line_break? / ';' / '|' / tab / line_break

A quote that never closes, or closes before other characters, makes ``quoted`` fail; the parser backtracks and
reads the value as ``bare`` with the error flag ``malformed_quote``.

Defined results: null fields give no value; an empty field gives one empty value. Fields of any length are
read whole in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords of instrument files whose entries hold lists, and those among them that hold n, n names, n * n numbers.
LIST_KEYS = ("spillover", "spill", "comp", "tr", "laserwavelength", "lasername", "cells")
MATRIX_KEYS = ("spillover", "spill", "comp")

_LINE = r"\r\n|\n|\r"
_PLAIN_SEPARATOR = rf"[;|\t]|{_LINE}"
_SEPARATOR = re.compile(rf",(?:[ \xa0]*(?:{_LINE}))?|{_PLAIN_SEPARATOR}")
_DECIMAL_SEPARATOR = re.compile(rf"(?:(?<!\d),|,(?!\d))(?:[ \xa0]*(?:{_LINE}))?|{_PLAIN_SEPARATOR}")
_BLANK = re.compile(r"[ \xa0]*")
_MARKS = {'"': '"', "'": "'", "“": "”", "«": "»", "`": "`"}
_QUOTED = {a: re.compile(f"{a}((?:{b}{b}|[^{b}])*){b}") for a, b in _MARKS.items()}
_BRACKETS = {"[": "]", "(": ")", "{": "}"}
_NUMBER = re.compile(r"[-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+]?\d+)?|[-+]?(?:nan|inf(?:inity)?)|n/?a|-+", re.I)
_POINT = re.compile(r"\d\.\d")
_IN_QUOTES, _BETWEEN = re.compile(r'"[^"]*"|\'[^\']*\''), re.compile(r"(?<=\d),(?=\d)")
_NO_NUMBER = re.compile(r"[^\d,;|]*")  # a damaged number; two numbers run together hold digits
_DECIMAL_COMMA = re.compile(r"[-+]?\d+,\d+(?:[eE][-+]?\d+)?")


def _bracketed(text: str, at: int) -> int:
    """End of the balanced bracket that opens at ``at``; -1 if it doesn't close."""
    stack = []
    for i in range(at, len(text)):
        c = text[i]
        if c in _BRACKETS:
            stack.append(_BRACKETS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
    return -1


def parse(text: str, decimal_comma: bool = False, brackets: bool = True) -> list[tuple[int, str, str | None]]:
    """(position, value, error flag) of every value of ``text``, by the grammar above."""
    separator = _DECIMAL_SEPARATOR if decimal_comma else _SEPARATOR
    out: list[tuple[int, str, str | None]] = []
    at, end, pos = 0, len(text), 0
    while True:
        at = _BLANK.match(text, at).end()
        value, flag, after = None, None, at
        if at < end and text[at] in _QUOTED:
            if m := _QUOTED[text[at]].match(text, at):
                stop = _BLANK.match(text, m.end()).end()
                if stop == end or separator.match(text, stop):
                    mark = _MARKS[text[at]]
                    value, after = m[1].replace(mark + mark, mark), stop
            if value is None:
                flag = "malformed_quote"
        elif brackets and at < end and text[at] in _BRACKETS:
            stop = _bracketed(text, at)
            if stop > 0:
                stop = _BLANK.match(text, stop).end()
                if stop == end or separator.match(text, stop):
                    value, after = text[at:stop].rstrip(" \xa0"), stop
            if value is None:
                flag = "malformed_bracket"
        if value is None:
            m = separator.search(text, at)
            after = m.start() if m else end
            value = text[at:after]
        out.append((pos, value.strip(" \xa0"), flag))
        m = separator.match(text, after)
        if not m:
            return out
        at, pos = m.end(), pos + 1


def _fits_matrix(values: list[str]) -> int:
    """2 for n, n names and n * n numbers, 1 for a list cut short, 0 for anything else."""
    while values and not values[-1]:
        values = values[:-1]
    if not values or not re.fullmatch(r"[0-9]{1,18}", values[0]) or not (n := int(values[0])):
        return 0
    numbers = [v for v in values[n + 1 :] if v]
    if not all(_NUMBER.fullmatch(v) or _NO_NUMBER.fullmatch(v) for v in numbers) or sum(bool(_NUMBER.fullmatch(v)) for v in values[1 : n + 1]):
        return 0
    total = 1 + n + n * n
    return 2 if len(values) == total else int(len(values) < total)


def parse_matrix(text: str) -> list[tuple[int, str, str | None]]:
    """Values of a matrix entry. The comma as separator and the comma as decimal sign are ordered alternatives.

    Where commas stand between digits only and no number has a point, the decimal sign is tried first; else the
    separator. The first alternative whose values have the entry's shape is taken; of two lists cut short, the one
    that reads every ``digits,digits`` as a number, as no list separated by commas holds so few.
    """
    plain = parse(text)
    if not _DECIMAL_COMMA.search(text):
        return plain
    fit = _fits_matrix([v for _, v, _ in plain])
    bare = _IN_QUOTES.sub("", text)
    decimal_first = not _POINT.search(bare) and len(_BETWEEN.findall(bare)) == bare.count(",")
    if fit == 2 and not decimal_first:
        return plain
    decimal = parse(text, decimal_comma=True)
    other = _fits_matrix([v for _, v, _ in decimal])
    return decimal if other >= (1 if decimal_first else max(fit, 1)) else plain


def parse_entry(keyword: str, text: str) -> list[tuple[int, str, str | None]]:
    """Values of an entry of an instrument file: a matrix, whose numbers may have a decimal comma, or any list, where commas separate."""
    if keyword in MATRIX_KEYS:
        return parse_matrix(text)
    return parse(text)


_RESULT = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("error", T.StringType())]))


@F.pandas_udf(_RESULT)
def _split_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([None if v is None else [{"pos": p, "item": i, "error": e} for p, i, e in parse(v)] for v in s], dtype=object)


@F.pandas_udf(_RESULT)
def _split_entries(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for keys, values in batches:
        yield pd.Series(
            [
                None if v is None else [{"pos": p, "item": i, "error": e} for p, i, e in parse_entry(k, v)]
                for k, v in zip(keys, values)
            ],
            dtype=object,
        )


def split_column(df: DataFrame, column: str, pos: str = "pos", item: str = "item", error: str = "error") -> DataFrame:
    """One row for each value of a string column, with position and error flag; other columns stay.

    Names of the new columns that clash with existing ones replace these.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (pos, item, error)]
    rows = df.select(*rest, F.explode(_split_lists(F.col(column))).alias("_value"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in (pos, item, error)], F.col("_value.pos").alias(pos), F.col("_value.item").alias(item), F.col("_value.error").alias(error))


def file_lists(texts: DataFrame, keys: tuple[str, ...] = LIST_KEYS) -> DataFrame:
    """(text_id, keyword, pos, item, error) of every value in the list entries of instrument files.

    Empty values keep their position. Null maps and missing entries give no row; repeated rows repeat.
    """
    entries = F.map_entries(F.map_filter("text_map", lambda k, v: k.isin(*keys) & v.isNotNull()))
    rows = texts.select("text_id", F.inline(entries).alias("keyword", "_packed"))
    values = rows.select("text_id", "keyword", F.explode(_split_entries("keyword", "_packed")).alias("v"))
    return values.select("text_id", "keyword", "v.pos", "v.item", "v.error")


def file_list_items(texts: DataFrame) -> DataFrame:
    """Distinct (text_id, keyword, pos, item) of the non-empty values; rows that repeat a text_id count once."""
    found = file_lists(texts).filter("text_id IS NOT NULL AND item != ''")
    return found.select("text_id", "keyword", "pos", "item").distinct()
