"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from .common import WHITE, digest, lower_az, stage


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_az(F.btrim(line, F.lit(WHITE)))


def _same_row(docs: DataFrame, text: str, doc_id: str) -> list[Column]:
    """A row is known by its id and its text: ids may be missing or repeated."""
    a, b = digest(F.col(text))
    return [F.col(doc_id).alias("__id"), a.alias("__t1"), b.alias("__t2")]


def repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keys (as 128-bit hashes ``k1``, ``k2``) of lines found in ``min_docs`` documents or more.

    ``keeper`` is the largest document id holding the key.  The distinct count and the
    maximum combine before the shuffle, so one very common line is no hot spot.
    """
    return _keys(docs, text, doc_id, min_chars).transform(_common, min_docs)


def _keys(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    lines = docs.select(*_same_row(docs, text, doc_id), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("__id", "__t1", "__t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    a, b = digest(F.col("key"))
    return keyed.select("__id", "__t1", "__t2", "pos", a.alias("k1"), b.alias("k2"))


def _common(keys: DataFrame, min_docs: int) -> DataFrame:
    return (
        keys.groupBy("k1", "k2")
        .agg(F.count_distinct(F.struct("__id")).alias("n_docs"), F.max("__id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def line_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Each document without the lines that ``min_docs`` or more documents hold.

    Lines are exploded with their position, normalised and hashed to 128 bits; distinct
    documents are counted per hash; of a hash over the threshold all lines go, except in
    the largest document id that holds it.  What is left is put together by position.
    The result is ``docs`` with ``text`` replaced and ``n_lines`` (before), ``n_dropped``
    added; columns of these names are replaced.

    Keys are staged, so texts are split and hashed once.  Only hashes travel to the
    counting and to the join with the common keys, in which a hot key is split by
    adaptive execution.  Texts are shuffled once, to meet the list of
    their own dropped positions.

    Null and empty texts are one empty line and become the empty text.  Rows with the
    same id count as one document; rows without an id count as one document that is
    smaller than any other.  Repeated rows are treated alike.  An empty table gives an
    empty one.  Very long texts need no special care: the work per row is linear.
    """
    keys = stage(_keys(docs, text, doc_id, min_chars), "line-keys")
    common = stage(_common(keys, min_docs), "line-common")  # so that the join shuffles both sides and can split a hot key
    drops = (
        keys.join(common, ["k1", "k2"])
        .where(~F.col("__id").eqNullSafe(F.col("keeper")))
        .groupBy("__id", "__t1", "__t2")
        .agg(F.collect_set("pos").alias("__drop"))
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(F.struct(*names).alias("row"), *_same_row(docs, text, doc_id)).alias("l")
    right = drops.alias("r")
    both = left.join(
        right,
        F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__t1") == F.col("r.__t1")) & (F.col("l.__t2") == F.col("r.__t2")),
        "left",
    ).select(F.col("row"), F.coalesce(F.col("row")[text], F.lit("")).alias("t"), F.col("__drop"))

    def without(lines: Column) -> Column:
        left_over = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(left_over, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col("__drop").isNull(), F.col("t")).otherwise(let(F.split("t", "\n"), without))
    out = both.select(
        F.col("row"),
        kept.alias("kept"),
        F.size(F.split("t", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return out.select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in names], "n_lines", "n_dropped")
