"""Mixing of sources, languages and topics to target shares of tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_RUN, column, discard, free_name, stage

DIMS = ("source", "lang", "topic")

# Words by which the topic of a text is told in the registered query; the first rule that
# holds wins, and a text without any is "general".
TOPICS = (("legal", ("licens", "Licens")), ("contact", ("@", "http")), ("table", (" | ",)))


def topic_of(text: Column, topics=TOPICS) -> Column:
    """The first topic one of whose words the text holds, else ``general``."""
    out = None
    for name, words in topics:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(text.contains(w), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def token_count(text: Column) -> Column:
    """White-space tokens; a blank text has none."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, WHITE_RUN)
    return F.aggregate(F.array(parts), F.lit(0).cast("long"), lambda a, p: a + F.size(p) - F.when(p[0] == "", 1).otherwise(0)
                       - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0))


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Shares in proportion to tokens to the power ``alpha``: small categories gain."""
    mass = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("m"))
    return _normal(mass.where("m > 0"), dim)


def given(cells: DataFrame, dim: str, shares: Mapping[str, float], rest: float) -> DataFrame:
    """Stated shares; each category that is not stated has ``rest``.  Scaled to sum to one."""
    share = F.lit(rest)
    for value, s in shares.items():
        share = F.when(F.col(dim) == value, F.lit(float(s))).otherwise(share)
    return _normal(cells.where("tokens > 0").select(dim).distinct().select(dim, share.alias("m")), dim)


def _normal(mass: DataFrame, dim: str) -> DataFrame:
    total = mass.agg(F.sum("m").alias("s")).first()["s"]
    return mass.select(F.col(dim).alias("value"), (F.col("m") / F.lit(float(total or 1.0))).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = 8, small: int = 100_000) -> DataFrame:
    """Token weights of cells whose marginals meet the target shares.

    Iterative proportional fitting: for one dimension after the other, cell weights are
    scaled so that the sum of every category is its share of all tokens.  Each of the
    ``sweeps`` rounds is staged, so plans stay short.

    The shares are columns of the cell, joined once.  Up to ``small`` cells (counted) sit in
    one partition, where a sweep is three window sums without any shuffle; more cells
    are summed per category with combining and joined to the sums.
    """
    size = cells.agg(F.sum("tokens"), F.count("*")).first()
    total = F.lit(float(size[0] or 0))
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim, shares in targets.items():
        named = shares.select(F.col("value").alias("named"), F.col("share").alias("to_" + dim))
        now = now.join(named, F.col(dim).eqNullSafe(F.col("named"))).drop("named")
    last = now = stage(now, "mix-cells")
    for _ in range(sweeps):
        if size[1] <= small:
            now = now.coalesce(1)
        for dim in targets:
            if size[1] <= small:
                sums = F.sum("w").over(Window.partitionBy(dim))
                now = now.withColumn("w", F.when(sums > 0, F.col("w") * (F.col("to_" + dim) * total / sums)).otherwise(0.0))
            else:
                of = now.groupBy(F.col(dim).alias("value")).agg(F.sum("w").alias("sum"))
                now = now.join(of, F.col(dim).eqNullSafe(F.col("value"))).drop("value")
                now = now.withColumn("w", F.when(F.col("sum") > 0, F.col("w") * (F.col("to_" + dim) * total / F.col("sum"))).otherwise(0.0)).drop("sum")
        now = stage(now, "mix-cells")
        discard(last)
        last = now
    return now


def calibrate(cells: DataFrame, keep: float, rounds: int = 8) -> float:
    """The scale at which ``min(1, scale * w / tokens)`` keeps ``keep`` of all tokens.

    A cell whose rate reaches one stays whole, and the scale of the others rises until
    the expected number of tokens is met.  Only three sums come to the driver per round.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    scale = 0.0
    for _ in range(rounds):
        full = F.col("w") * F.lit(scale) >= F.col("tokens")
        row = cells.where("tokens > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("whole"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        new = (keep * total - (row["whole"] or 0)) / row["w"]
        if new <= scale:
            break
        scale = new
    return scale


def unit(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    *,
    topic: Column | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    alpha: float = 0.5,
    lang_shares: Mapping[str, float] | None = None,
    topic_shares: Mapping[str, float] | None = None,
    rest: float = 0.1,
    keep: float = 0.5,
    sweeps: int = 8,
    broadcast_cells: int = 100_000,
    small_cells: int = 100_000,
    names: Sequence[str] = ("topic", "tokens", "rate", "probability", "selected"),
) -> DataFrame:
    """Documents with their weight in a mix of given marginal shares, and a sample of it.

    Cells are combinations of source, language and topic.  Their token weights are raked
    to the marginals: sources in proportion to tokens to the power ``alpha``, languages
    and topics to stated shares.  ``rate`` is weight over tokens of the cell,
    ``probability`` the calibrated chance ``min(1, scale * rate)`` at which the expected
    tokens are ``keep`` of all, and ``selected`` whether a number drawn from the id lies
    below it.  The result is ``docs`` with these columns added (``names``); columns of
    these names are replaced.

    Missing sources and languages are categories of their own.  Texts without words weigh
    nothing: their cell counts no tokens for them, but they share its probability.  A
    cell without any token has probability 0.  Rows with the same id are drawn together,
    and rows without an id share one number.  An empty table gives an empty result.  Texts
    of any length are counted whole.  Further columns pass through, whatever their names.

    Up to ``small_cells`` cells are raked in one partition, more by joins (:func:`rake`).
    The table of cells meets the documents as a broadcast when it has at most
    ``broadcast_cells`` rows (counted first), and by a join otherwise.
    """
    topic = topic_of(F.col(text)) if topic is None else topic
    lang_shares = {"en": 0.45, "fr": 0.2, "de": 0.2, "es": 0.15} if lang_shares is None else lang_shares
    topic_shares = {"general": 0.8, "table": 0.1, "contact": 0.06, "legal": 0.04} if topic_shares is None else topic_shares
    marks = docs.select(F.col("source"), F.col("lang"), topic.alias("topic"), token_count(F.col(text)).alias("tokens"))
    cells = stage(marks.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-count")
    targets = {
        "source": tempered(cells, "source", alpha),
        "lang": given(cells, "lang", lang_shares, rest),
        "topic": given(cells, "topic", topic_shares, rest),
    }
    targets = {d: stage(t, "mix-target") for d, t in targets.items()}
    raked = rake(cells.where("tokens > 0"), targets, sweeps, small_cells)
    scale = calibrate(raked, keep)
    top, tok, rate, prob, sel = names
    base = docs.select([column(c) for c in docs.columns if c not in names])
    taken = base.withColumns({n: F.lit(None) for n in names if n not in base.columns})
    helper = {n: free_name(taken, "mix_" + n) for n in ("topic", "tokens", "source_of", "lang_of", "topic_of", "rate_of")}
    rates = raked.select(
        F.col("source").alias(helper["source_of"]), F.col("lang").alias(helper["lang_of"]), F.col("topic").alias(helper["topic_of"]),
        (F.col("w") / F.col("tokens")).alias(helper["rate_of"]),
    )
    if rates.count() <= broadcast_cells:
        rates = F.broadcast(rates)
    own = docs.select(*[column(c) for c in base.columns], topic.alias(helper["topic"]), token_count(F.col(text)).alias(helper["tokens"]))
    both = own.join(
        rates,
        F.col("source").eqNullSafe(F.col(helper["source_of"])) & F.col("lang").eqNullSafe(F.col(helper["lang_of"])) & (F.col(helper["topic"]) == F.col(helper["topic_of"])),
        "left",
    )
    found = F.coalesce(F.col(helper["rate_of"]), F.lit(0.0))
    p = F.least(F.lit(1.0), found * F.lit(scale))
    return both.select(
        *[column(c) for c in base.columns],
        F.col(helper["topic"]).alias(top),
        F.col(helper["tokens"]).alias(tok),
        found.alias(rate),
        p.alias(prob),
        (unit(F.col(doc_id)) < p).alias(sel),
    )
