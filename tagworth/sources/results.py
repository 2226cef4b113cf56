"""Nested results: one row per analysis, its items and rejections in tables of lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import chunk_lists, top_k
from ..operators.routing import place


def _listed(items: DataFrame, lead: Column | None, order: list[Column], name: str, size: int) -> DataFrame:
    entry = F.struct(*[c for c in items.columns if c != "analysis_id"])
    first = lead if lead is not None else (F.col("pos") if "pos" in items.columns else F.hash("url"))
    return chunk_lists(items, ["analysis_id"], [first, *order], first, entry, name, size)


def item_lists(items: DataFrame, lead: Column | None = None, size: int = 1000) -> DataFrame:
    """Items of an analysis in order, as lists of at most ``size``: ``analysis_id, part, items``.

    A table of its own, so that a large analysis is many rows here and one headline there.
    """
    return _listed(items, lead, place(items), "items", size)


def rejected_lists(rejected: DataFrame, size: int = 1000) -> DataFrame:
    """Rejections of an analysis in lists: ``analysis_id, part, filtered_items``."""
    return _listed(rejected, F.hash("reason_code", "url"), [F.col("url")], "filtered_items", size)


def nested_results(
    headline: DataFrame, items: DataFrame, rejected: DataFrame | None = None, lead: Column | None = None, first: int = 100
) -> DataFrame:
    """One row per analysis: headline numbers, counts, and its ``first`` items and rejections.

    The shape does not depend on the size of an analysis; all items are in
    :func:`item_lists` and :func:`rejected_lists`.
    """

    def of(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
        entry = F.struct(*[c for c in rows.columns if c != "analysis_id"])
        top = top_k(rows, ["analysis_id"], order, first, "_rank").select("analysis_id", F.struct("_rank", entry.alias("v")).alias("_e"))
        lists = top.groupBy("analysis_id").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["v"]).alias(name))
        return rows.groupBy("analysis_id").agg(F.count("*").alias("n_" + name)).join(lists, "analysis_id", "left")

    lead = lead if lead is not None else (F.col("pos") if "pos" in items.columns else F.hash("url"))
    out = headline.join(of(items, [lead, *place(items)], "items"), "analysis_id", "left")
    if rejected is not None:
        out = out.join(of(rejected, [F.hash("reason_code", "url"), F.col("url")], "filtered_items"), "analysis_id", "left")
    counts = [c for c in out.columns if c in ("n_items", "n_filtered_items")]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def write_results(df: DataFrame, path: str, format: str = "json", day: str = "day") -> None:
    """Write nested results partitioned by day."""
    dated = df if day in df.columns else df.withColumn(day, F.current_date())
    dated.write.mode("append").partitionBy(day).format(format).save(path)


class ResultStore:
    """Tables of results that a stream writes exactly once.

    A batch is stored under its number in every table, replacing what an earlier attempt left,
    and counts only once its line in the manifest is there; readers take the batches of
    the manifest.  So a batch that runs twice, or stops half-way, is stored once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def write(self, batch_id: int, tables: Mapping[str, DataFrame]) -> bool:
        """Store the tables of a batch; false if the batch was stored before."""
        if self._has(f"{self.path}/manifest/batch={batch_id}/_SUCCESS"):
            return False
        for name, df in tables.items():
            df.drop("batch").write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        done = self.spark.range(1).select(F.lit(",".join(sorted(tables))).alias("tables"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        return True

    def each_batch(self, tables_of: Callable[[DataFrame], Mapping[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: the tables made of each batch are stored once."""

        def store(df: DataFrame, batch_id: int) -> None:
            self.write(batch_id, tables_of(df))

        return store

    def batches(self) -> DataFrame:
        """Numbers of the complete batches."""
        if not self._has(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], "batch bigint")
        found = self.spark.read.schema("tables string, batch bigint").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")
        return found.where("tables IS NOT NULL").select("batch").distinct()

    def read(self, name: str) -> DataFrame:
        """A table, from complete batches only."""
        return self.spark.read.parquet(f"{self.path}/{name}").join(self.batches(), "batch", "left_semi")

    def compact(self, name: str, max_files: int = 1) -> int:
        """Rewrite batches of a table that have more than ``max_files`` files as one file each.

        Returns how many were rewritten.  A batch is replaced as a whole, under its number,
        so readers see the same rows before and after.
        """
        table = self.spark.read.parquet(f"{self.path}/{name}")
        files = table.select("batch", F.input_file_name().alias("f")).distinct().groupBy("batch").count()
        many = files.where(F.col("count") > max_files).select("batch").join(self.batches(), "batch", "left_semi").cache()
        n = many.count()
        if n:
            rows = table.join(F.broadcast(many), "batch", "left_semi").repartition("batch")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")
        many.unpersist()
        return n
