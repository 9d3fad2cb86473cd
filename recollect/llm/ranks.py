"""Places of rows in the order of their group, without a window over a group: sorted ranges, counts of ranges, offsets."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from recollect.llm.frames import stage, stage_narrow


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], pos: str = "pos", size: str = "size") -> DataFrame:
    """``rows`` with their place (from 0) in their group by ``order``, and the group's number of rows.

    Rows are dealt by ranges of (group, order), so a group of any size is many tasks; a range has one row of counts for
    each of its groups, and only those are summed up in a window. Group columns must not be null. Rows should be narrow.
    """
    by = [*(F.col(g) for g in group), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", *group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size))
    counts = stage_narrow(counts, "range-counts")
    return placed.join(counts, ["_range", *group]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(pos), size)
