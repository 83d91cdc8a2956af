"""Column expressions on paths and sizes of listed files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXCLUDED_DIRS, GENERATED, LANGUAGES, Settings


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """Last suffix in lower case; empty for names with none and for dotfiles."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def parents_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_vendored(path: Column) -> Column:
    """Whether a directory above the file is in the excluded set."""
    return F.arrays_overlap(parents_of(path), F.array(*map(F.lit, EXCLUDED_DIRS)))


def max_bytes(path: Column, settings: Settings = Settings()) -> Column:
    return F.when(F.lower(path).endswith(".ipynb"), F.lit(settings.notebook_cap)).otherwise(F.lit(settings.file_cap)).cast("long")


def skip_reason(path: Column, size: Column, settings: Settings = Settings()) -> Column:
    """Why a listed file isn't indexed; null to keep it. The first rule that holds gives the reason."""
    name = F.lower(name_of(path))
    generated = F.lit(False)
    for end in GENERATED:
        generated = generated | name.endswith(end)
    return (
        F.when(~suffix_of(path).isin(*settings.suffixes), "extension")
        .when(is_vendored(path), "excluded_dir")
        .when(generated, "generated")
        .when(size > max_bytes(path, settings), "too_large")
        .when(size == 0, "empty")
    )


def language_of(path: Column, default: str = "text") -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix_of(path)), F.lit(default))
