"""Text quality rules whose limits follow the data of each language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import let
from .common import stage, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A measured quantity and how far beyond a quantile of its group it may lie.

    The upper limit is the ``percent`` quantile plus ``times`` its distance to the median, or
    plus ``floor`` where no group shows any distance.  ``low`` also bounds the quantity
    from below, by the mirrored quantile.
    """

    name: str
    percent: int
    times: int
    floor: int
    low: bool = False


# Units: per 1000 words, per 1000 lines, and hundredths of a character.  Symbols and word
# lengths of bad texts lie far out, and such texts may be many: quartiles stand them.
RULES = (
    Rule("symbols", 75, 4, 50),
    Rule("shouts", 99, 6, 50),
    Rule("dup_lines", 99, 2, 100),
    Rule("repeats", 99, 2, 50),
    Rule("word_length", 75, 12, 20, low=True),
)
TAIL_DOCS = 3


def window_keys(words: Column, width: int = WINDOW) -> Column:
    """A 64-bit key of each run of ``width`` words (a power of two), by doubling."""

    def doubled(keys: Column, step: int) -> Column:
        return let(
            keys,
            lambda k: let(
                F.greatest(F.size(k) - step, F.lit(0)),
                lambda n: F.zip_with(F.slice(k, 1, n), F.slice(k, step + 1, n), lambda a, b: F.xxhash64(a, b)),
            ),
        )

    out, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        out, step = doubled(out, step), step * 2
    return out


def repeated_words(keys: Column, width: int = WINDOW) -> Column:
    """How many words lie in runs that occur twice or more.

    Keys are sorted with their positions, equal neighbours give the positions of repeated
    runs, and each adds the words that the run before it did not reach.
    """

    def covered(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.transform(
                F.filter(
                    s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) & (j > 0) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
                ),
                lambda x: x["i"],
            ),
        )
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(twice),
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))


def measured(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of every whole text, as ``doc_id, lang, source`` and one column each."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(text, F.lit("")).alias("t")
    )
    words = base.withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return words.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]{2,}")).cast("long").alias("n_shouts"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        repeated_words(window_keys(F.col("w"))).alias("n_repeat_words"),
    ).select("*", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines")).drop("l")


def _coarse(v: Column) -> Column:
    """``v`` with its six leading bits: the bucket of a mergeable quantile sketch."""
    unit = F.pow(F.lit(2.0), F.greatest(F.char_length(F.bin(v)) - 6, F.lit(0))).cast("long")
    return v - v % unit


def _values() -> list[Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))

    def share(c: str, of: Column, scale: int) -> Column:
        return F.floor(F.col(c) * scale / of).cast("long")

    return [
        share("n_symbols", words, 1000),
        share("n_shouts", words, 1000),
        share("n_dup_lines", lines, 1000),
        share("n_repeat_words", words, 1000),
        share("word_chars", words, 100),
    ]


def sketches(measures: DataFrame) -> DataFrame:
    """Bucket counts per language, source and rule: a sketch that merges by adding counts.

    A value is kept to six leading bits, so a sketch has at most some two thousand
    buckets and a quantile is low by less than 1/32.  Counts do not depend on the order
    of merging.
    """
    return (
        measures.where(~F.col("base_failed"))
        .select("lang", "source", F.posexplode("values").alias("rule", "v"))
        .select("lang", "source", "rule", _coarse(F.col("v")).alias("v"))
        .groupBy("lang", "source", "rule", "v")
        .agg(F.count("*").alias("n"))
    )


def _by_rule(rules: tuple[Rule, ...], field: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("rule") + 1)


def _quantiles(sketch: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Median, quantile of the rule, its mirror and size; the window runs over buckets, not rows."""
    merged = sketch.groupBy("level", "lang", "source", "rule", "v").agg(F.sum("n").alias("n"))
    keys = ["level", "lang", "source", "rule"]
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select(*keys, "v", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    reached = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("v")))
    percent = _by_rule(rules, "percent")
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), reached(F.lit(50)).alias("mid"), reached(percent).alias("up"), reached(100 - percent).alias("down"))


def limits(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, min_docs: int = 50) -> DataFrame:
    """Lower and upper limits per language and source, as arrays in rule order.

    A rule takes the limit of the group itself where the group has ``min_docs`` documents,
    at least ``TAIL_DOCS`` of them beyond the quantile, and a distance between quantile and
    median; else that of the language, under the same terms, else that of all.
    ``limit_level`` is the closest level that any rule of a group uses.
    """
    none = F.lit(None).cast("string")

    def spread(lang: str, source: str) -> Column:
        """A group as a member of itself, its language and all."""
        return F.explode(
            F.array(
                F.struct(F.lit(2).alias("level"), F.col(lang).alias("lang"), F.col(source).alias("source")),
                F.struct(F.lit(1).alias("level"), F.col(lang).alias("lang"), none.alias("source")),
                F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")),
            )
        )

    levels = sketch.select("rule", "v", "n", spread("lang", "source").alias("g")).select("g.*", "rule", "v", "n")
    up, down = F.col("up") - F.col("mid"), F.col("mid") - F.col("down")
    times, floor, low = (_by_rule(rules, f) for f in ("times", "floor", "low"))
    enough = (F.col("total") >= min_docs) & (F.col("total") * (100 - _by_rule(rules, "percent")) >= 100 * TAIL_DOCS) & (up > 0)
    bounds = _quantiles(levels, rules).where(enough | (F.col("level") == 0)).select(
        "level", "lang", "source", "rule",
        F.when(low, F.col("down") - F.greatest(floor, times * down)).otherwise(F.lit(-1)).alias("lo"), (F.col("up") + F.greatest(floor, times * up)).alias("hi"),
    )
    groups = sketch.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).distinct()
    wanted = groups.select("g_lang", "g_source", spread("g_lang", "g_source").alias("w")).select(
        "g_lang", "g_source", F.col("w.level").alias("w_level"), F.col("w.lang").alias("w_lang"), F.col("w.source").alias("w_source")
    )
    found = wanted.join(
        bounds,
        (F.col("w_level") == F.col("level")) & F.col("w_lang").eqNullSafe(F.col("lang")) & F.col("w_source").eqNullSafe(F.col("source")),
    )
    closest = found.groupBy("g_lang", "g_source", "rule").agg(F.max_by(F.struct("lo", "hi"), "level").alias("b"), F.max("level").alias("level"))
    return closest.groupBy("g_lang", "g_source").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rule", "b"))), lambda x: x["b"]).alias("bounds"), F.max("level").alias("limit_level")
    )


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    rules: tuple[Rule, ...] = RULES,
    min_docs: int = 50,
) -> DataFrame:
    """Counts of each text and whether it is kept.

    Base rules are fixed: at least ``min_words`` words, and no more than
    ``max_repeat_percent`` of the words in 8-word runs that occur twice or more.  Texts
    that pass them feed quantile sketches per language and source; from the quantiles of
    a sketch follow the limits of five further quantities (:func:`limits`), and a text
    outside the limits of its own group is not kept.

    Result per row: ``doc_id, lang, source``, the counts, ``values`` (the five
    quantities), ``base_failed``, ``limit_level`` (2 own group, 1 language, 0 all) and
    ``kept``.  Null and empty texts have no words and fail the base rules.  A missing
    language or source is a group of its own.  Repeated rows count as often as they
    occur.  An empty table gives an empty result; further columns are not read.  Texts of
    any length are measured whole.

    Texts are read once and never shuffled: counts are staged, sketches combine within
    tasks, and limits are joined to counts only.
    """
    measures = measured(docs, text=text, doc_id=doc_id, lang=lang, source=source)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measures = stage(measures.withColumn("values", F.array(*_values())).withColumn("base_failed", failed), "quality-measures")
    bounds = stage(limits(sketches(measures), rules, min_docs), "quality-limits")
    both = measures.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.forall(F.zip_with("values", "bounds", lambda v, b: (v >= b["lo"]) & (v <= b["hi"])), lambda ok: ok)
    return both.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words",
        "values", "base_failed", "limit_level", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )
