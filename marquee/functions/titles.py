"""Catalogue text: release year, clean title, genre list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year given to titles without one when building features.
MISSING_YEAR = 1990
YEAR_AT_END = r"\((\d{4})\)\s*$"
GENRE_SEPARATOR = r"\|"


def release_year(title: Column, default: int = MISSING_YEAR) -> Column:
    """Year in brackets at the end of the title, else `default`."""
    found = F.regexp_extract(F.coalesce(title, F.lit("")), YEAR_AT_END, 1)
    return F.coalesce(found.try_cast("int"), F.lit(default))


def clean_title(title: Column) -> Column:
    """Title without its trailing year."""
    return F.trim(F.regexp_replace(F.trim(title), YEAR_AT_END, ""))


def genre_list(genres: Column) -> Column:
    """Pipe-joined genres as an array; empty when there are none."""
    blank = genres.isNull() | (F.trim(genres) == "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(
        F.split(genres, GENRE_SEPARATOR)
    )


def slot(values: Column, i: int) -> Column:
    """Element `i` or NULL when the array is shorter."""
    return F.get(values, F.lit(i))
