"""Tokens as columns: pieces by regular expression, bytes, and ids of a vocabulary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexpack.functions.vocabulary import PATTERN, Vocabulary
from lexpack.operators import jvm


def pieces(text: Column | str, pattern: str = PATTERN) -> Column:
    """The pieces of a text in order; with the default pattern they join to the text. Null gives null.

    Spark's engine has ASCII white space unless told otherwise, hence ``(?U)`` for patterns that ask for it. The default pattern is three
    classes of characters, told apart on the JVM without the engine.
    """
    if pattern == PATTERN and (cut := jvm.function("Pieces", "array<string>")):
        return cut(text)
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def byte_pieces(data: Column, pattern: str = PATTERN) -> Column:
    """The pieces of bytes as binaries: those of the text if they are valid UTF-8, else one."""
    valid = F.is_valid_utf8(data.cast("string"))
    return F.when(valid, F.transform(pieces(data.cast("string"), pattern), lambda p: F.encode(p, "UTF-8"))).otherwise(F.array(data))


def byte_ids(data: Column) -> Column:
    """The ids of the plain byte vocabulary, without leaving the JVM.

    Latin-1 makes every byte a character, and a split by the empty string is linear, which substrings by place are not.
    """
    characters = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(characters, F.ascii))


def from_byte_ids(ids: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2, "0")), ""))


def encode(vocabulary: Vocabulary):
    """A function from a binary column to ids (array<int>)."""

    @F.pandas_udf("array<int>")
    def ids(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else vocabulary.encode(bytes(b)))

    return ids


def decode(vocabulary: Vocabulary):
    @F.pandas_udf("binary")
    def data(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else vocabulary.decode([int(i) for i in x]))

    return data


def records(raw: Column) -> Column:
    """A file's records: its non-empty lines (without a trailing CR) if it has two newlines or more, else the whole."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))
    many = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) >= 2
    return F.when(many, F.filter(lines, lambda x: x != "")).when(raw.isNotNull(), F.array(raw))
