"""Running sums over the rows of a document that may be too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of a document that are summed in one task.
BLOCK = 1 << 16


def sum_before(table: DataFrame, value: Column, out: str, id_col: str = "doc_id", order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """table with `out`, the sum of value over the rows of the document with a smaller position, 0 for the first.

    value is an integer column, order an integer position without ties in a document; a null position comes first. A
    document spans tasks, as its positions are cut into blocks: the sums of blocks, few and added up map-side, are carried
    to the blocks after them as one more row that leads each block, so the rows themselves are shuffled once, by document
    and block, and joined with nothing. Documents of one block take no such row. Columns _block and _lead are used up.
    """
    place = F.coalesce(F.floor(F.col(order) / F.lit(block)).cast("long"), F.lit(-(1 << 62)))
    laid = table.withColumn("_block", place).withColumn(out, value.cast("long"))
    earlier = Window.partitionBy(id_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy(id_col, "_block").agg(F.sum(out).alias("s")).withColumn(out, F.sum("s").over(earlier))
    leads = sums.filter(F.col(out) != 0).select(id_col, "_block", out, F.lit(0).alias("_lead"))
    rows = laid.withColumn("_lead", F.lit(1)).unionByName(leads, allowMissingColumns=True)
    before = Window.partitionBy(id_col, "_block").orderBy("_lead", order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(out, F.coalesce(F.sum(out).over(before), F.lit(0)))
    return summed.filter("_lead = 1").drop("_block", "_lead")
