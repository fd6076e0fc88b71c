"""Row numbers inside groups that may be hot.

``Window.partitionBy(group).orderBy(key)`` sends a whole group to one task. Here
the rows are range-partitioned and sorted on (group, key) once, so a large group
spans many partitions, and each row is stamped with ``monotonically_increasing_id``
(partition id in the high bits, position inside the partition in the low bits).
That table is written once; positions and the per-(partition, group) counts are
both read from the written copy, so they always agree (range bounds come from
sampling, and two separately planned range shuffles could pick different bounds).
A row's number is the count of its group in earlier partitions plus its position
after the group's first row in its own partition. The count table has at most
#partitions + #groups rows, is written too and broadcast if it fits; then the rows
themselves are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators import sizing


def row_number_in_groups(df: DataFrame, group: str, order: str | list[str], out: str = "row_number",
                         n_parts: int | None = None) -> DataFrame:
    """1-based position of each row inside its ``group`` ordered by ``order``, nulls first; every row gets a
    number of its own, equal ones in any order. Null groups are one group."""
    orders = [order] if isinstance(order, str) else list(order)
    spark = df.sparkSession
    n = n_parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    r = df.repartitionByRange(n, group, *orders).sortWithinPartitions(group, *orders)
    r = sizing.materialize(r.withColumn("_mid", F.monotonically_increasing_id()))
    r = r.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    stats = r.groupBy("_pid", group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(F.col("_pid").alias("_opid"), F.col(group).alias("_group"), "_first",
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    offsets = sizing.materialize(offsets)
    if sizing.fits_broadcast(offsets, row_bytes=256):  # else the rows are exchanged once more
        offsets = F.broadcast(offsets)
    numbered = r.join(offsets, (F.col("_pid") == F.col("_opid")) & F.col(group).eqNullSafe(F.col("_group")))
    return numbered.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long")).drop(
        "_pid", "_opid", "_mid", "_group", "_first", "_off")
