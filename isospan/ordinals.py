"""Numbers of rows in an order, without one task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

#: Where a row stands in the files that it was read from: path, start of the split, place among the split's rows.
PLACE = ("__file", "__at", "__n")
#: Splits of files whose rows are summed up together: of a million splits 250 sums meet in one task.
BLOCK = 4096


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's number from 0 in the order, which no two rows should share: dealt by range, numbered within the
    parts, and moved on by the rows of the parts before, of which there are as many as shuffle partitions."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    count = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    before = [(p, sum(n for q, n in count.items() if q < p)) for p in count]
    moved = F.broadcast(spark.createDataFrame(before, "__part int, __before bigint"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(moved, "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def placed(df: DataFrame) -> DataFrame:
    """Rows just read from files, with their place in these (see PLACE)."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"))


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Rows of placed() with their numbers from 0 in the order of the files' paths, and in these in theirs. Only numbers
    of rows by split are put in order together. The place is left out."""
    rows = materialize(df)
    splits = rows.groupBy("__file", "__at").agg(F.min("__n").alias("__first"), F.count("*").alias("__count"))
    parts = ranked(splits, "__k", "__file", "__at").withColumn("__block", F.floor(F.col("__k") / BLOCK))
    # The rows before a split: of the blocks of splits before its own, and of those before it in there.
    blocks = parts.groupBy("__block").agg(F.sum("__count").alias("__all"))
    moved = ranked_sums(blocks)
    inner = F.coalesce(F.sum("__count").over(Window.partitionBy("__block").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.withColumn("__inner", inner).join(moved, "__block").select("__file", "__at", "__first", (F.col("__inner") + F.col("__moved")).alias("__before"))
    return rows.join(before, ["__file", "__at"]).withColumn(name, F.col("__before") + F.col("__n") - F.col("__first")).drop(*PLACE, "__first", "__before")


def ranked_sums(blocks: DataFrame) -> DataFrame:
    """__block, __moved: the rows of all blocks before each; a block stands for BLOCK splits, so there are few."""
    total = F.sum("__all").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("__block", F.coalesce(total, F.lit(0)).alias("__moved"))


def last_of(df: DataFrame, key: str) -> DataFrame:
    """One row of placed() for each key, the last of the files."""
    rest = [c for c in df.columns if c not in (key, *PLACE)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*PLACE)).alias("__r"))
    return last.select(key, "__r.*")
