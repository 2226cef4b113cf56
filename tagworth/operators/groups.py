"""Group tools that stay safe when one group holds a large part of all rows.

Orders are lists of ascending columns (negate a number to sort it descending) and must
be total, so that results do not depend on the input partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their rank.

    Spark cuts every input partition to ``k`` rows per group before the shuffle, so at
    most ``k`` rows per group and task travel, whatever the size of the group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def beyond_top(df: DataFrame, top: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The rows of ``df`` that :func:`top_k` left out.

    Compares every row with the order key of the last kept row, so no group is ranked
    as a whole.
    """
    marked = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    last = top.filter(F.col(rank) == k).select(
        *keys, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("_last")
    )
    return marked.join(last, keys).filter(F.col("_key") > F.col("_last")).drop("_key", "_last")


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    lead: Column | None = None,
    rank: str = "rank",
    parts: int | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rank every row of every group, without sorting a large group in one task.

    Rows are dealt to ranges of (keys, order), so a group of any size, with any ties in
    its leading columns, is cut into even parts; ``parts`` ranges, or as many as Spark's
    shuffles have.  A row's rank is the size of the group's earlier ranges plus its place
    in its own.  ``lead``, if given, is a number that rises with ``order`` and is compared
    before it.  The rows move once: they are written to the shared folder in order, each with
    its range and place, so only the counts of groups are left to find.  Columns beside the
    keys and those of ``keep``, if given, do not get that far.
    """
    columns = [*[F.col(k) for k in keys], *([] if lead is None else [lead]), *order]
    dealt = df.repartitionByRange(*columns) if parts is None else df.repartitionByRange(parts, *columns)
    names = df.columns if keep is None else list(dict.fromkeys([*keys, *keep]))
    # the number of the range in the upper bits, that of the row in it in the lower 33
    placed = staged(dealt.sortWithinPartitions(*columns).select(*names, F.monotonically_increasing_id().alias("_at")))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = staged(offsets.select(*keys, "_part", shift.alias("_shift")))  # of known size: few groups do not move the rows again
    return placed.join(offsets, [*keys, "_part"]).withColumn(rank, (F.col("_at") + F.col("_shift")).cast("int")).drop("_part", "_at", "_shift")


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: made once, and of a size that later joins know.

    Shuffle files of the rows' making go when they are written, not when the driver collects its garbage.
    """
    from ..streaming.run import shared_dir

    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    was = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, was)
    return spark.read.schema(df.schema).parquet(path)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per group and distinct value; combined before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def chunk_lists(df: DataFrame, keys: list[str], order: list[Column], lead: Column, item: Column, name: str, size: int = 1000) -> DataFrame:
    """Nested lists of at most ``size`` items; larger groups give several rows.

    Columns: the keys, ``part`` (from 0) and the list.
    """
    ranked = rank_in_group(df, keys, order, lead, "_rank")
    entry = F.struct(F.col("_rank").alias("r"), item.alias("v"))
    return (
        ranked.withColumn("part", F.floor((F.col("_rank") - 1) / size).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name))
    )
