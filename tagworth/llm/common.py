"""Helpers shared by the text operators: white space, case, staged tables, numpy tokens."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters and the letters that are lower-cased.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_az(c: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` is several times faster than ``translate`` but folds other letters too, so
    it serves only texts that are all ASCII.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(c: Column) -> Column:
    """The maximal runs without ASCII white space, in order; null and blank give no word."""
    parts = F.split(F.coalesce(c, F.lit("")), WHITE_RUN)
    return F.transform(
        F.array(parts),
        lambda w: F.slice(
            w,
            F.when(w[0] == "", 2).otherwise(1),
            F.greatest(
                F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0),
                F.lit(0),
            ),
        ),
    )[0]


def digest(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, for use as one 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``.  Only a session on one machine may do without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tagworth-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run meanwhile go when each ends, not when the driver collects its garbage."""
    was = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, was)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BUILT: dict[str, object] = {}


class Shared:
    """A broadcast value and what each worker process builds of it, once."""

    def __init__(self, spark: SparkSession, value, build) -> None:
        self.key, self.sent, self.build = uuid.uuid4().hex, spark.sparkContext.broadcast(value), build

    def get(self):
        if self.key not in _BUILT:
            while len(_BUILT) > 1:  # tables of earlier queries; a query uses two at most
                _BUILT.pop(next(iter(_BUILT)))
            _BUILT[self.key] = self.build(self.sent.value)
        return _BUILT[self.key]

    def end(self) -> None:
        """Free the value on driver and executors; for results that are staged."""
        self.sent.destroy()

    def __getstate__(self):
        return self.key, self.sent, self.build

    def __setstate__(self, state) -> None:
        self.key, self.sent, self.build = state


def column(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def byte_slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose summed size stays near ``limit``; at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
