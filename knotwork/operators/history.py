"""A clean history of changing attributes from unordered, repeated and late records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.canonical import canonical_json


def attribute_history(records: DataFrame, commits: DataFrame) -> DataFrame:
    """(qualified_name, from_ord, to_ord, valid_from, valid_to, properties) per version.

    Gaps and islands: among the records of one name and start the latest recorded_at counts (on equal
    times the highest id, then the later end); each holds to its valid_to and at most to the commit
    before the next start; where neither the hash of the properties changes nor a commit lies between,
    the version goes on. A running sum of the breaks numbers the islands.

    A record starts at valid_from, or at valid_to if valid_from is null; without a known start, or
    without a name, it is left out. A valid_to that is null, unknown or before the start sets no end.
    valid_to is the empty string (to_ord null) while a version is open. properties is the canonical text
    of the version's value. Records of one name shrink to one per commit before the shuffle, so a name
    holding a third of all rows costs its partition no more rows than there are commits.
    """
    pos = commits.where("sha is not null").groupBy("sha").agg(F.min("ord").alias("ord"))
    start = pos.select(F.col("sha").alias("_start"), F.col("ord").alias("s"))
    end = pos.select(F.col("sha").alias("_end"), F.col("ord").alias("e"))
    text = canonical_json(F.col("properties"))
    rows = records.where("qualified_name is not null").select(
        "qualified_name", "recorded_at", "id", F.coalesce("valid_from", "valid_to").alias("_s"), F.col("valid_to").alias("_e"),
        "properties",
    )
    rows = rows.join(start, F.col("_s") == F.col("_start")).join(end, F.col("_e") == F.col("_end"), "left")
    rows = rows.select("qualified_name", "s", "recorded_at", "id", F.when(F.col("e") >= F.col("s"), F.col("e")).alias("e"), text.alias("p"))
    latest = rows.groupBy("qualified_name", "s").agg(F.max(F.struct("recorded_at", "id", "e", "p")).alias("r"))
    w = Window.partitionBy("qualified_name").orderBy("s")
    held = latest.select("qualified_name", "s", "r.e", "r.p", F.xxhash64("r.p").alias("h"), (F.lead("s").over(w) - 1).alias("before"))
    held = held.withColumn("to", F.least("e", "before"))
    broken = F.coalesce((F.lag("h").over(w) != F.col("h")) | (F.lag("to").over(w) + 1 < F.col("s")), F.lit(True))
    islands = held.withColumn("broken", broken.cast("int")).withColumn("island", F.sum("broken").over(w))
    spans = islands.groupBy("qualified_name", "island").agg(
        F.min("s").alias("from_ord"), F.max(F.struct("s", "to")).alias("last"), F.min_by("p", "s").alias("properties")
    )
    spans = spans.select("qualified_name", "from_ord", F.col("last.to").alias("to_ord"), "properties")
    by_pos = commits.where("sha is not null").groupBy("ord").agg(F.min("sha").alias("sha"))
    first = by_pos.select(F.col("ord").alias("from_ord"), F.col("sha").alias("valid_from"))
    last = by_pos.select(F.col("ord").alias("to_ord"), F.col("sha").alias("_last"))
    return spans.join(first, "from_ord", "left").join(last, "to_ord", "left").select(
        "qualified_name", "from_ord", "to_ord", "valid_from",
        F.when(F.col("to_ord").isNull(), F.lit("")).otherwise(F.col("_last")).alias("valid_to"), "properties",
    )
