"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.canonical import canonical_json


def stack_snapshots(older: DataFrame, latest: DataFrame, number: int) -> DataFrame:
    """Snapshots (with snap_no) and the latest full table, snapshot ``number``, as one frame."""
    columns = ["qualified_name", "line_start", "properties", "delivered_at"]
    return older.select("snap_no", *columns).unionByName(
        latest.select(F.lit(number).cast("int").alias("snap_no"), *columns))


def snapshot_changes(snapshots: DataFrame, first: int, last: int) -> DataFrame:
    """(snap_no, qualified_name, change) for each snapshot after ``first`` up to ``last`` against the one before.

    change is ``added``, ``removed`` or ``changed`` (line_start, null equal to null, or properties as
    JSON values). Spaces around a name don't count. Of the rows of one name in a snapshot the one
    delivered last counts; on equal times the highest line_start, then the greatest properties. Rows
    without a name or snapshot number are left out. A snapshot number without rows is an empty snapshot.

    EXCEPT ALL both ways as one signed bag: a row counts +1 in its own comparison and -1 in the next
    one, and rows whose counts cancel vanish before the shuffle is even read by the second step. What
    is left over on either side is then joined in full by key to name the change. The value is a hash of
    line_start and canonical properties, so rows in the second shuffle stay small.
    """
    value = F.xxhash64(F.coalesce(F.col("line_start").cast("string"), F.lit("-")), canonical_json(F.col("properties")))
    rows = snapshots.select(
        F.col("snap_no").cast("int").alias("snap_no"), F.trim("qualified_name").alias("qualified_name"), "line_start", "properties", "delivered_at"
    ).where(f"snap_no between {first} and {last} and qualified_name is not null")
    rows = rows.select("snap_no", "qualified_name", F.struct("delivered_at", "line_start", value.alias("h")).alias("r"))
    current = rows.groupBy("snap_no", "qualified_name").agg(F.max("r").alias("r")).select("snap_no", "qualified_name", "r.h")
    ways = F.array(
        F.struct(F.col("snap_no").alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("snap_no") + 1).alias("at"), F.lit(-1).alias("sign")),
    )
    bag = current.select("qualified_name", "h", F.explode(ways).alias("w")).select(
        F.col("w.at").alias("snap_no"), "qualified_name", "h", "w.sign"
    ).where(f"snap_no > {first} and snap_no <= {last}")
    # one exchange on the key serves the bag difference and the join of its two residues
    keyed = bag.repartition("snap_no", "qualified_name")
    residue = keyed.groupBy("snap_no", "qualified_name", "h").agg(F.sum("sign").alias("n")).where("n <> 0")
    sides = residue.groupBy("snap_no", "qualified_name").agg(F.max("n").alias("new"), F.min("n").alias("old"))
    change = F.when(F.col("old") > 0, "added").when(F.col("new") < 0, "removed").otherwise("changed")
    return sides.select("snap_no", "qualified_name", change.alias("change"))
