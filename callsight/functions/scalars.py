"""One-row results used as values in other queries.

A global aggregate (a total, a flag, a top-k summary) is attached to every
row of another table as a scalar subquery: Spark runs it once, before the
outer query, and passes the value in. No join node, no exchange of the
outer rows, and sibling subqueries over the same plan are merged.

Every reference to a scalar value is planned as its own subquery, so a
value used more than once is attached as a column once (a ``select``) and
read through that column; long expressions over it then cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct value; read its fields with ``one_row(df)["name"]``."""
    return df.select(F.struct(*df.columns).alias("r")).scalar()


def one_value(df: DataFrame, name: str | None = None) -> Column:
    """One column of a one-row DataFrame as a value (the only column if ``name`` is None)."""
    return (df.select(name) if name else df).scalar()
