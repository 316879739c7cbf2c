"""Columns of tables whose other columns may have any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """Where column ``name`` stands; the exact name wins over one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"no single column {name} among {df.columns}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0``, ``c1`` and so on.

    Names with dots, names that differ only in case and names that an operator
    uses for itself then can't clash; ``toDF(*df.columns)`` puts them back.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def key(df: DataFrame, name: str) -> str:
    """The name of ``df``'s column ``name`` in :func:`numbered`."""
    return f"c{place(df, name)}"


def column(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` itself, whatever its name holds."""
    own = df.columns[place(df, name)]
    if sum(c.lower() == own.lower() for c in df.columns) == 1:
        return F.col("`" + own.replace("`", "``") + "`")
    raise ValueError(f"{name} differs from another column only in case; give the table through numbered()")
