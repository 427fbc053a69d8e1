"""Column expressions on texts that several operators share.  JVM-side only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = "\t\n\x0b\f\r "  # the characters 0x09-0x0D and 0x20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters other than 0x09-0x0D and 0x20; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE[:-1], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def without(text: Column, characters: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), characters, "")


def free_prefix(columns: list[str], prefix: str) -> str:
    """``prefix``, lengthened until no column begins with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row but maps: rows with equal ids and hashes are equal."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)])
