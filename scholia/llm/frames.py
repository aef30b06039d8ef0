"""Frames whose columns may have any names, and ids of any size.

``positional`` renames columns by place, so that an operator's own names clash with
none of the caller's. Ids go through Python as text: a null beside them would turn a
pandas column of longs into doubles, which hold no long above 2**53.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with columns ``c0, c1, ...``, its names, and the new names of the ``wanted`` columns."""
    names = docs.columns
    places = [f"c{names.index(w)}" for w in wanted]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), names, places


def named(df: DataFrame, names: list[str], **extra: Column) -> DataFrame:
    """The columns of ``positional`` under their old names, and more beside."""
    columns = [F.col(f"c{i}") for i in range(len(names))]
    return df.select(*columns, *extra.values()).toDF(*names, *extra)


def id_text(c: str | Column) -> Column:
    """A long id as text for Python."""
    return (F.col(c) if isinstance(c, str) else c).cast("long").cast("string")


def id_long(c: str | Column) -> Column:
    """The long of an ``id_text``."""
    return (F.col(c) if isinstance(c, str) else c).cast("long")
