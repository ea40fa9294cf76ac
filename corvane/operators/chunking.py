"""Line windows, file rebuild, covering chunks, line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_blank, split_lines

CHUNK_LINES = 80


def line_windows(files: DataFrame, max_lines: int = CHUNK_LINES) -> DataFrame:
    """files(file_path, language, content, ...) to chunks (…, chunk_no, start_line, end_line, content).

    Windows do not overlap; blank files and blank windows give none, and a gap stays where they were.
    One narrow projection: windows are sliced from the line array, nothing is shuffled.
    """
    keep = [c for c in files.columns if c != "content"]
    lines = split_lines(F.col("content"))
    rows = files.filter(~is_blank(F.col("content"))).select(*keep, lines.alias("_lines"))

    def window(start: Column) -> Column:
        part = F.slice("_lines", start + 1, max_lines)
        return F.struct((start / max_lines).cast("int").alias("chunk_no"), (start + 1).alias("start_line"), (start + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("content"))

    starts = F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(max_lines))
    return rows.select(*keep, F.inline(F.transform(starts, window))).filter(~is_blank(F.col("content")))


def rebuild_files(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """chunks(keys, start_line, content) to (keys, content): lines at their numbers, gaps empty, later chunks win.

    A single chunk is taken as it is; otherwise the text begins at the smallest line number.
    """
    parts = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    grouped = chunks.groupBy(*keys).agg(parts.alias("parts")).withColumn("first", F.col("parts")[0]["start_line"])

    def place(acc: Column, part: Column) -> Column:
        lines = F.split(part["content"], "\n")
        at = part["start_line"] - F.col("first")
        head = F.slice(acc, 1, at)
        fill = F.when(F.size(head) < at, F.array_repeat(F.lit(""), at - F.size(head))).otherwise(F.array().cast("array<string>"))
        tail = F.slice(acc, at + F.size(lines) + 1, F.greatest(F.size(acc), F.lit(1)))
        return F.concat(head, fill, lines, tail)

    whole = F.array_join(F.aggregate("parts", F.array().cast("array<string>"), place), "\n")
    return grouped.select(*keys, F.when(F.size("parts") == 1, F.col("parts")[0]["content"]).otherwise(whole).alias("content"))


def covering_chunk(line: Column, max_lines: int = CHUNK_LINES) -> Column:
    """Number of the line window that holds a 1-based line: arithmetic in place of a range join."""
    return F.floor((line - 1) / max_lines).cast("int")


def chunks_of_span(start: Column, end: Column, max_lines: int = CHUNK_LINES) -> Column:
    """Numbers of all line windows that overlap a span of lines."""
    return F.sequence(covering_chunk(start, max_lines), covering_chunk(F.greatest(end, start), max_lines))


def extract_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, clamped) joined by breaks."""
    low, high = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    return F.when(high >= low, F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")).otherwise("")


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Overlapping or adjacent inclusive ranges of each key merged (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def uncovered_lines(totals: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_uncovered, first_line, last_line) of the lines 1..n_lines outside the merged ranges; (1, 1) if none.

    Aggregated from range bounds, with map-side combine; no lines are unfolded and no ranges gathered.
    """
    n = F.col("n_lines").cast("int")
    # greatest and least skip nulls: without the last condition, a file without ranges would count as covered
    low, high = F.greatest("start_line", F.lit(1)), F.least("end_line", n)
    real = (high >= low) & F.col("start_line").isNotNull()
    inside = totals.join(merged, keys, "left").withColumn("_n", n).withColumn("_s", F.when(real, low)).withColumn("_e", F.when(real, high))
    # merged ranges do not touch, so only the range at line 1 moves the first line and the one at line n the last
    out = inside.groupBy(*keys, "_n").agg(
        F.coalesce(F.sum(F.col("_e") - F.col("_s") + 1), F.lit(0)).alias("covered"), F.coalesce(F.max(F.when(F.col("_s") == 1, F.col("_e") + 1)), F.lit(1)).alias("first"), F.min(F.when(F.col("_e") == F.col("_n"), F.col("_s") - 1)).alias("last")
    )
    left = (F.col("_n") - F.col("covered")).cast("int")
    return out.select(*keys, left.alias("n_uncovered"), F.when(left > 0, F.col("first")).otherwise(1).cast("int").alias("first_line"), F.when(left > 0, F.coalesce("last", "_n")).otherwise(1).cast("int").alias("last_line"))
