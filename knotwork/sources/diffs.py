"""Unified diffs as a table of hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_diff(lines: DataFrame) -> DataFrame:
    """(diff_id, path, old_start, old_count, new_start, new_count) of diffs' lines (diff_id, line_no, line).

    The path is that of the last ``+++ b/`` or else ``diff --git`` line before the hunk; a missing count is 1.
    """
    new = F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1)
    git = F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1)
    path = F.when(new != "", new).when(git != "", git)
    running = F.last(path, ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("line_no"))
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda i: F.regexp_extract("line", head, i)
    count = lambda i: F.when(part(i) == "", 1).otherwise(F.try_to_number(part(i), F.lit("9999999999")).cast("int"))
    rows = lines.withColumn("path", running).where(F.col("line").rlike(head))
    return rows.select("diff_id", "path", part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, line_no, line) of whole texts (diff_id, text)."""
    return diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
