"""Text templates filled with column values.

A template is plain text with ``{name}`` placeholders. Filling it gives one
``concat`` of literal pieces and columns, evaluated per row on the
executors; braces that are not a known placeholder stay literal text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` of ``values`` replaced by that column."""
    if not values:
        return F.lit(template)
    parts = re.split(r"\{(" + "|".join(re.escape(k) for k in values) + r")\}", template)
    cols: list[Column] = []
    for i, part in enumerate(parts):
        if i % 2:
            cols.append(values[part])
        elif part:
            cols.append(F.lit(part))
    return F.concat(*cols) if cols else F.lit("")
