"""Line expressions. A line ends at \\n, \\r\\n or \\r; a final line end opens no further line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "// ... (truncated)"


def lines(text: Column) -> Column:
    """Lines without their ends; none for an empty text."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Number of \\n, plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def head(text: Column, n: int) -> Column:
    """The first n lines, and a mark if there are more."""
    all_lines = lines(text)
    return F.when(F.size(all_lines) > n, F.concat(F.array_join(F.slice(all_lines, 1, n), "\n"), F.lit("\n" + TRUNCATED))).otherwise(text)
