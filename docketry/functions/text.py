"""Column functions over text, dates and code lists. All are built-ins that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column, header: str = "THE FACTS\n", joiner: str = "") -> Column:
    """Stripped, then without a header, then with line breaks replaced by ``joiner``; in that order."""
    return F.replace(F.replace(strip(c), F.lit(header), F.lit("")), F.lit("\n"), F.lit(joiner))


def drop_extension(c: Column, extension: str = ".txt") -> Column:
    """Every literal occurrence removed."""
    return F.replace(c, F.lit(extension), F.lit(""))


def word_count(c: Column) -> Column:
    """Runs without white space of any kind; 0 for the empty text, null for null."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def part(c: Column, separator: str, index: int) -> Column:
    """The index-th part (from 0); null if there are fewer."""
    return F.get(F.split(c, separator), F.lit(index))


def map_codes(codes: Column, names: Column) -> Column:
    """Codes mapped to their text, in order; unknown ones left out."""
    return F.filter(F.transform(codes, lambda k: F.try_element_at(names, k)), lambda x: x.isNotNull())


def any_code(codes: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, wanted)))


def any_substring(c: Column, wanted: list[str]) -> Column:
    """Whether any wanted string stands anywhere in the raw list: also inside longer codes."""
    return F.exists(F.array(*map(F.lit, wanted)), lambda k: F.contains(c, k))


def keep_codes(codes: Column, wanted: list[str]) -> Column:
    return F.filter(codes, lambda x: x.isin(wanted))


def parse_timestamp(c: Column, pattern: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    return F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(pattern))


def key_order(seed: str, key: Column) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
