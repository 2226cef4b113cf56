"""Fill-in-middle transformation: cuts at token boundaries found by a learned rank index."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import byte_slices, column, free_name
from .tokens import buffer_of

SLICE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BYTES = np.arange(256)
_IS_LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_BEGINS = (_BYTES & 0xC0) != 0x80  # first byte of a code point


class RankIndex(NamedTuple):
    """Offsets of sorted boundaries as straight lines over their ranks, and what they miss.

    Segment s begins at rank ``first[s]``, where it has offset ``start[s]``, and rises by
    ``slope[s]`` per rank.  ``residual`` holds the offset minus the rounded line for every
    rank; no residual is beyond ``error``, so that one byte each is enough.
    """

    first: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the lines alone."""
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.start[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets: the prediction and its stored residual."""
        return self.predict(ranks) + self.residual[ranks]


def fit_ranks(offsets: np.ndarray, rows: np.ndarray, error: int = 127) -> RankIndex:
    """Index of ``offsets``; ``rows`` are the ranks at which a text begins (the first is 0).

    Every text starts as one segment, a line through its first and last boundary.
    Segments that miss a boundary by more than ``error`` are halved, all at once, until
    none does; a segment of two boundaries misses none.
    """
    n = len(offsets)
    first = np.asarray(rows, dtype=np.int64)
    start, slope = np.zeros(0, np.int64), np.zeros(0)
    residual = np.zeros(n, dtype=np.int8)
    done = []
    last = np.append(first[1:], n) - 1
    while len(first):
        span = last - first
        start = offsets[first]
        slope = (offsets[last] - start) / np.maximum(span, 1)
        sizes = span + 1
        at = np.repeat(np.arange(len(first)), sizes)
        begin = np.cumsum(sizes) - sizes
        step = np.arange(len(at)) - begin[at]
        rank = first[at] + step
        miss = offsets[rank] - start[at] - np.rint(slope[at] * step).astype(np.int64)
        worst = np.maximum.reduceat(np.abs(miss), begin)
        good = worst <= error
        fine = good[at]
        residual[rank[fine]] = miss[fine]
        done.append((first[good], start[good], slope[good]))
        lo, hi = first[~good], last[~good]
        mid = (lo + hi) // 2
        first, last = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi])
    if not done:
        return RankIndex(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), residual)
    parts = [np.concatenate(p) for p in zip(*done)]
    order = np.argsort(parts[0], kind="stable")
    return RankIndex(*(p[order] for p in parts), residual)


def boundaries(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all token boundaries of texts, ends included, and the first rank of each.

    Tokens are runs of ASCII letters and single other code points.  A text of n tokens has
    n + 1 boundaries; the end of one text and the start of the next are two boundaries
    at the same offset.
    """
    letter = _IS_LETTER[raw]
    begins = _BEGINS[raw]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    if len(inner):
        inner[0] = False
        cuts = at[:-1][at[:-1] < len(raw)]
        inner[cuts] = False  # a text does not go on with the letters of the one before
    token = np.flatnonzero(begins & ~inner)
    upto = np.searchsorted(token, at)  # tokens before each text
    n = np.diff(upto)
    offsets = np.empty(len(token) + len(n), dtype=np.int64)
    ends = upto[1:] + np.arange(len(n))
    own = np.ones(len(offsets), dtype=bool)
    own[ends] = False
    offsets[own] = token
    offsets[ends] = at[1:]
    return offsets, upto[:-1] + np.arange(len(n))


def _cut(columns: list[str], text: str, error: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h1, h2 = (batch.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in columns[-2:])
            raw_all, at_all = buffer_of(batch.column(columns.index(text)))
            for i, j in byte_slices(np.diff(at_all), SLICE):
                raw, at = raw_all[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                offsets, first = boundaries(raw, at)
                index = fit_ranks(offsets, first, error)
                n = np.diff(np.append(first, len(offsets))) - 1
                one, two = h1[i:j] % (n + 1), h2[i:j] % (n + 1)
                lo, hi = index.lookup(first + np.minimum(one, two)), index.lookup(first + np.maximum(one, two))
                chars = np.zeros(len(raw) + 1, dtype=np.int64)
                np.cumsum(_BEGINS[raw], out=chars[1:])
                p, m = chars[lo] - chars[at[:-1]], chars[hi] - chars[lo]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(columns) - 2], *(pa.array(x, pa.int64()) for x in (n, p, m))], [*columns[:-2], "n", "p", "m"]
                )

    return run


def _drawn(doc_id: Column, salt: str, k: int) -> Column:
    """The k-th group of eight digits of the SHA-256 of ``salt:id``, as a number."""
    name = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(name, 8 * k - 7, 8), 16, 10).cast("long")


def fill_middle(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    salt: str = "1",
    fim_percent: int = 90,
    spm_percent: int = 20,
    error: int = 127,
    names=("n", "form", "prefix_chars", "middle_chars", "output"),
) -> DataFrame:
    """``docs`` with each text cut into prefix, middle and suffix and put together anew.

    Tokens are runs of ASCII letters and single other code points.  Two of the n + 1
    token boundaries are drawn from the id (with repeats, so parts may be empty); the
    prefix ends at the first, the middle at the second.  Of the texts, ``fim_percent`` in a
    hundred are transformed, of these ``spm_percent`` in a hundred into
    ``<S>suffix<P>prefix<M>middle`` (spm), the others into ``<P>prefix<S>suffix<M>middle``
    (psm).  All others stay as they are (plain), as do empty texts and texts that
    hold one of the three marks.

    The offset of a drawn boundary comes from an index learned over all boundaries of the
    texts at hand: straight lines from rank to offset, each at most ``error`` (127 or less)
    bytes off, predict it and a stored residual corrects it.

    Columns ``names`` are added, or replaced where they exist: tokens, form, code points
    of prefix and middle (null in plain form) and the output.  A null text is empty; a
    null id draws as the empty id does.  Rows with the same id have the same draws, and repeated
    rows give repeated results.  Long texts are worked on whole; batches of texts in
    slices of about a megabyte.  An empty table gives an empty result.  Further
    columns pass through, whatever their names.  Nothing is shuffled.
    """
    if not 0 < error <= 127:
        raise ValueError("residuals are stored in a byte: error must be from 1 to 127")
    base = docs.select([column(c) for c in docs.columns if c not in names or c in (text, doc_id)])
    kept = [c for c in base.columns if c not in names]
    taken = base.withColumns({n: F.lit(None) for n in names if n not in base.columns})
    row, body, u1, u2 = (free_name(taken, "fim_" + c) for c in ("row", "text", "u1", "u2"))
    given = base.select(
        F.struct(*[column(c) for c in base.columns]).alias(row), F.coalesce(F.col(text), F.lit("")).alias(body),
        _drawn(F.col(doc_id), salt, 1).alias(u1), _drawn(F.col(doc_id), salt, 2).alias(u2),
    )
    schema = StructType([*given.schema.fields[:2], *(StructField(c, LongType()) for c in "npm")])
    cut = given.mapInArrow(_cut(given.columns, body, error), schema)
    t, p, m = F.col(body), F.col("p"), F.col("m")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    own_id = F.col(row)[doc_id]
    form = F.when((t == "") | marked | (_drawn(own_id, salt, 3) % 100 >= fim_percent), "plain")
    form = form.when(_drawn(own_id, salt, 4) % 100 < spm_percent, "spm").otherwise("psm")
    formed = cut.withColumn("form", form)
    prefix, suffix = F.substring(t, F.lit(1), p.cast("int")), F.substring(t, (p + m + 1).cast("int"), F.char_length(t))
    middle = F.substring(t, (p + 1).cast("int"), m.cast("int"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(t)
    )
    cuts = [F.when(F.col("form") != "plain", c) for c in (p, m)]
    made = [F.col("n"), F.col("form"), *cuts, output]
    return formed.select(*[F.col(row).getField(c).alias(c) for c in kept], *[c.alias(n) for c, n in zip(made, names)])


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation.

    A transformed text holds each mark once, since texts with a mark stay plain and a mark
    cannot arise where parts meet; so the marks part it exactly.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
