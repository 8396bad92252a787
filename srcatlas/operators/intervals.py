"""Interval merge, budgeted prefix and anchored extraction of long files."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import paths
from ..functions import text as T
from ..lang.lexer import braces

# Limits of the extraction.
WHOLE_LINES, METHOD_LINES, TOTAL_LINES, FALLBACK_LINES, LINE_WIDTH = 200, 40, 100, 40, 80
SPANS = "array<struct<s:int,e:int>>"
# Lines that start a method or type.
KOTLIN_ANCHOR = r"^\s*(public|open|abstract|override|internal)?\s*(fun|class|interface|abstract class)\s+\w+"
SWIFT_ANCHOR = r"^\s*(public|open|internal)?\s*(func|class|struct|protocol)\s+\w+"


def block_ends(lines: list[str], anchors: list[int], interpolation: str = "${") -> list[int]:
    """For each anchor line the line that closes the first block opened on it or below; FALLBACK_LINES further, at
    most, where no block opens or the block stays open. Braces pair up over the file's tokens, once for all anchors,
    so those in strings, character literals and comments are none."""
    opened: list[int] = []
    pairs: list[list[int]] = []  # [line of the opener, line of its closer], by opener
    for brace, line in braces("\n".join(lines), interpolation):
        if brace == "{":
            opened.append(len(pairs))
            pairs.append([line, -1])
        elif opened:
            pairs[opened.pop()][1] = line
    starts = [a for a, _ in pairs]
    out = []
    for anchor in anchors:
        k = bisect_left(starts, anchor)
        closed = pairs[k][1] if k < len(pairs) else -1
        out.append(closed if closed >= 0 else min(anchor + FALLBACK_LINES, len(lines) - 1))
    return out


def join_near(spans: Column, gap: int = 2) -> Column:
    """Spans (s, e) in order, joined while the next starts at most `gap` after the end so far."""
    far = lambda acc, r: (F.size(acc) == 0) | (r["s"] > F.element_at(acc, -1)["e"] + gap)
    longer = lambda acc, r: F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], r["e"]).alias("e"))
    return F.aggregate(spans, F.array().cast(SPANS), lambda acc, r: F.when(far(acc, r), F.concat(acc, F.array(r))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer(acc, r)))))


def within_budget(spans: Column, most: int) -> Column:
    """Spans (s, e) before the first with which their lines are more than `most`."""
    start = F.struct(F.array().cast(SPANS).alias("out"), F.lit(0).alias("n"))
    # the sum goes on past the limit, so that nothing after the first that does not fit comes in
    def step(acc, r):
        n = acc["n"] + (r["e"] - r["s"] + 1)
        return F.struct(F.when(n <= most, F.concat(acc["out"], F.array(r))).otherwise(acc["out"]).alias("out"), n.alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def shortened(lines: list[str], anchor: re.Pattern, interpolation: str, max_method_lines: int, max_total_lines: int) -> str:
    """The first methods and types of a long file within the budget; its first lines where it has none."""
    anchors = [k for k, x in enumerate(lines) if anchor.match(x)]
    if not anchors:
        return "\n".join(lines[:max_total_lines])
    kept: list[list[int]] = []  # [first line, last line], joined while the next starts at most 2 after the end so far
    used = 0
    for a, e in zip(anchors, block_ends(lines, anchors, interpolation)):
        e = min(e, a + max_method_lines - 1)
        used += e - a + 1
        if used > max_total_lines:  # nothing after the first that does not fit comes in
            break
        if kept and a <= kept[-1][1] + 2:
            kept[-1][1] = max(kept[-1][1], e)
        else:
            kept.append([a, e])
    return f"\n{T.TRUNCATED}\n\n".join("\n".join(lines[a : e + 1]) for a, e in kept)


def extract(files: DataFrame, max_method_lines: int = METHOD_LINES, max_total_lines: int = TOTAL_LINES) -> DataFrame:
    """files (file_path, content) with `extract`: short files whole, long ones as their first methods and types
    within the budget, with a mark where lines are left out. Files without content are left out."""
    names = files.columns

    def run(batches):
        kotlin, swift = re.compile(KOTLIN_ANCHOR, re.ASCII), re.compile(SWIFT_ANCHOR, re.ASCII)
        for batch in batches:
            out = []
            for content, ext in zip(batch.column("content").to_pylist(), batch.column("_ext").to_pylist()):
                lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if not lines[-1]:
                    lines.pop()
                if len(lines) <= WHOLE_LINES:
                    out.append(content)
                elif ext in (".kt", ".kts"):
                    out.append(shortened(lines, kotlin, "${", max_method_lines, max_total_lines))
                elif ext == ".swift":
                    out.append(shortened(lines, swift, "\\(", max_method_lines, max_total_lines))
                else:
                    out.append(content[: max_total_lines * LINE_WIDTH])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "extract"])

    schema = StructType([*files.schema.fields, StructField("extract", StringType())])
    return files.where("content is not null").withColumn("_ext", paths.extension(F.col("file_path"))).mapInArrow(run, schema)
