"""Column names: they carry ``°``, ``%``, ``+`` and dots, so they are always quoted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROPPED = str.maketrans({" ": "_", "(": None, ")": None})


def col(c: str | Column) -> Column:
    """A Column from a plain name, whatever characters it holds."""
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def tidy_name(name: str) -> str:
    return str(name).strip().lower().translate(_DROPPED)


def tidy_names(df: DataFrame, prefix: str = "", keep: Iterable[str] = ()) -> DataFrame:
    """Trimmed, lower-case, underscored names without brackets, optionally prefixed."""
    held = set(keep)
    return df.toDF(*[n if n in held else prefix + tidy_name(n) for n in df.columns])


def add_prefix(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    held = set(keep)
    return df.toDF(*[n if n in held else prefix + n for n in df.columns])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Drop later columns that repeat an earlier name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    places: dict[str, int] = {}
    for i, n in enumerate(names):
        places.setdefault(n, i)
    by_place = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_place.select([F.col(f"_{i}").alias(n) for n, i in places.items()])


def drop_export_junk(df: DataFrame) -> DataFrame:
    """Drop spreadsheet leftovers: ``unnamed*`` and ``*iso_time``."""
    keep = [n for n in df.columns if not n.lower().startswith("unnamed") and not n.lower().endswith("iso_time")]
    return df.select([col(n) for n in keep])


def fix_spelling(df: DataFrame, wrong_to_right: dict[str, str]) -> DataFrame:
    """Rename a misspelt column, or drop it when the right one is there as well."""
    for wrong, right in wrong_to_right.items():
        if wrong in df.columns:
            df = df.drop(wrong) if right in df.columns else df.withColumnRenamed(wrong, right)
    return df


def keep_renamed(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Keep only the listed columns that exist, under their new names."""
    return df.select([col(old).alias(new) for old, new in renames.items() if old in df.columns])


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The candidates that the table has, in candidate order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def numeric_names(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [n for n, t in df.dtypes if t.startswith(kinds)]


def binary_names(names: Iterable[str], suffix: str, extra: Iterable[str]) -> list[str]:
    listed = set(extra)
    return [n for n in names if n.endswith(suffix) or n in listed]
