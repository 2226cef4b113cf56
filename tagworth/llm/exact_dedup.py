"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RUN, digest, discard, stage

Fingerprint = Callable[[Column], list[Column]]
NO_PARTNER = -(2**63)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def _blocks(text: Column, size: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _named(values: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows sorted into integer names.

    Rows are hashed to partitions and sorted within them; a name is the partition number
    and the rank in it.  Staged, so that every later step sees the same names.
    """
    return values.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _block_names(docs: DataFrame, text: str, size: int, fingerprint: Fingerprint) -> tuple[DataFrame, DataFrame | None]:
    """Names of the distinct blocks by fingerprint, and by text where fingerprints clash.

    Grouping is by fingerprint and whole block text, so different blocks never share a
    name.  A fingerprint that stands for one block text can be looked up without the
    text; clashing ones are named apart and looked up by the text itself.
    """
    blocks = docs.select(F.explode(_blocks(normalised(F.col(text)), size)).alias("block"))
    a, b = fingerprint(F.col("block"))
    distinct = blocks.select(a.alias("f1"), b.alias("f2"), "block").distinct()
    names = stage(_named(distinct, ["block"]).select("f1", "f2", "name"), "block-names")
    clash = names.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    if clash.isEmpty():
        return names, None
    clash = stage(clash, "block-clashes")
    apart = distinct.join(clash, ["f1", "f2"]).select("block", "f1", "f2")
    by_text = stage(_named(apart, ["block"]).select("block", (-1 - F.col("name")).alias("name")), "clash-names")
    return names.join(clash, ["f1", "f2"], "left_anti"), by_text


def exact_dedup(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", block_chars: int = 2048, fingerprint: Fingerprint = lambda c: digest(c)
) -> DataFrame:
    """Groups of documents whose texts are equal up to the length of white-space runs.

    A text is cut into blocks of ``block_chars`` characters.  Distinct blocks are sorted
    into integer names; then adjacent pairs of names are named in the same way, level by
    level, until each document has one name.  Two documents have the same level and name
    exactly when their texts are equal: names stand for whole blocks or whole pairs, and
    no step relies on a hash being free of collisions.

    Result: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.
    The row with the smallest id stays; an id that is missing sorts last, and of several
    rows with the smallest id exactly one stays.  Null is the empty text.  An empty table
    gives an empty result; other columns of the input are not read.

    Texts are shuffled once, to name blocks, after distinct blocks were combined within
    each task; later levels move integers only.  A level halves the names of a document,
    so the number of levels is the logarithm of the longest text.  Names of common
    blocks are met by joins that adaptive execution splits.
    """
    names, by_text = _block_names(docs, text, block_chars, fingerprint)
    norm = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("id"), normalised(F.col(text)).alias("t"))
    cut = norm.select("rid", "id", F.sha2("t", 256).alias("sha"), _blocks(F.col("t"), block_chars).alias("blocks"))

    def mark(block: Column) -> Column:
        a, b = fingerprint(block)
        parts = [a.alias("f1"), b.alias("f2")]
        return F.struct(*parts, block.alias("block")) if by_text is not None else F.struct(*parts)

    rows = stage(cut.select("rid", "id", "sha", F.transform("blocks", mark).alias("marks")), "block-rows")
    parts = rows.select("rid", F.posexplode("marks").alias("pos", "m")).select("rid", "pos", "m.*")
    named = parts.join(names, ["f1", "f2"], "inner" if by_text is None else "left")
    if by_text is not None:
        named = named.join(by_text.withColumnRenamed("name", "apart"), "block", "left").withColumn("name", F.coalesce("apart", "name"))
    level = stage(_in_order(named), "block-level-0")
    done: list[DataFrame] = []
    used: list[DataFrame] = [names] if by_text is None else []
    n_level = 0
    while True:
        done.append(level.where(F.size("ids") == 1).select("rid", F.lit(n_level).alias("level"), F.col("ids")[0].alias("name")))
        open_ = level.where(F.size("ids") > 1)
        if open_.isEmpty():
            break
        pairs = open_.select(
            "rid",
            F.posexplode(
                F.expr(
                    "transform(sequence(0, (size(ids) + 1) div 2 - 1), i -> "
                    f"struct(ids[2 * i] AS a, coalesce(get(ids, 2 * i + 1), {NO_PARTNER + 1} - 1) AS b))"
                )
            ).alias("pos", "p"),
        ).select("rid", "pos", "p.a", "p.b")
        pair_names = stage(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        n_level += 1
        level = stage(_in_order(pairs.join(pair_names, ["a", "b"])), f"block-level-{n_level}")
        discard(pair_names)
    discard(*used)
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionAll(more)
    found = rows.select("rid", "id", "sha").join(identity, "rid")
    groups = found.groupBy("level", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))).alias("first"), F.count("*").alias("group_size")
    )
    return found.join(groups, ["level", "name"]).select(
        F.col("id").alias(doc_id),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _in_order(named: DataFrame) -> DataFrame:
    """The names of each document as one array, by position."""
    return (
        named.groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("s"))
        .select("rid", F.transform("s", lambda x: x["name"]).alias("ids"))
    )
