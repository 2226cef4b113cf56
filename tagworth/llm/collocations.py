"""Phrase collocations from stripes: counters of next words under each prefix of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, byte_slices, column, discard, stage
from .tokens import LOWER, buffer_of, mixed, word_keys

SLICE = 1 << 20
BITS = 26

_BYTES = np.arange(256)
_IS_BREAK = np.isin(_BYTES, [*b".,;:!?", *range(0x0A, 0x0E)])
_IS_WORD = ~_IS_BREAK & ~np.isin(_BYTES, [0x20, 0x09])
_STEP = np.uint64(0xB5026F5AA96619E9)


class Words(NamedTuple):
    """Words of many texts in order.

    ``joined`` holds them lower-cased with one space after each, so a run of words is
    one stretch of bytes.  ``run`` is the number of words from each on to the end of its piece.
    """

    joined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    run: np.ndarray
    rows: np.ndarray
    keys: np.ndarray


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    """Words of texts that each end in a line break."""
    low = LOWER[raw]
    solid = np.append(_IS_WORD[low], False)
    edge = np.diff(solid.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(_IS_BREAK[low], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    n = len(starts)
    last = np.append(np.flatnonzero(np.diff(piece)), n - 1) if n else np.zeros(0, np.int64)
    run = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
    keep = solid[: len(low)].copy()
    keep[ends] = True
    joined = np.where(solid[: len(low)], low, 0x20)[keep].astype(np.uint8)
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    return Words(joined, begin, begin + sizes, run, np.searchsorted(at, starts, side="right") - 1, word_keys(low, starts, ends))


def grams(keys: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of the ``width`` words from each place on."""
    out = np.full(len(places), np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _STEP + keys[places + j]
        return mixed(out)


def counted(key: np.ndarray, parts: list[np.ndarray], c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of ``parts`` and how often it occurs (the sum of ``c``).

    ``key`` is a hash of the row; rows are told apart by their parts, should hashes be equal.
    """
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    differs = key[order][1:] != key[order][:-1]
    other = np.zeros(len(differs), dtype=bool)
    for p in parts:
        q = p[order]
        other |= q[1:] != q[:-1]
    if (other & ~differs).any():  # equal in the hash alone
        order = np.lexsort((*parts, key))
        differs = key[order][1:] != key[order][:-1]
        for p in parts:
            q = p[order]
            differs |= q[1:] != q[:-1]
    first = np.flatnonzero(np.append(True, differs))
    if c is None:
        return order[first], np.diff(np.append(first, len(order)))
    return order[first], np.add.reduceat(c[order], first)


def text_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Stretches of bytes as an Arrow text column."""
    import pyarrow as pa

    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[take]))


def _slices(batches) -> Iterator[tuple[Words, np.ndarray, object]]:
    """Words of a slice of texts, a salt for the language of each word and the languages by row."""
    for batch in batches:
        langs = batch.column("lang")
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], dtype=np.uint64)
        raw, at = buffer_of(batch.column("text"))
        for i, j in byte_slices(np.diff(at), SLICE):
            words = words_of(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            yield words, salts[i:j][words.rows], langs.slice(i, j - i)


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    bit = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _batch(runs: list[np.ndarray], c: np.ndarray, columns: int):
    """Runs as columns ``w1, w2, ...``; those beyond the width of the run are null."""
    import pyarrow as pa

    words = [pa.array(r.view(np.int64)) for r in runs] + [pa.nulls(len(c), pa.int64())] * (columns - len(runs))
    return pa.RecordBatch.from_arrays([*words, pa.array(c)], [*(f"w{i + 1}" for i in range(columns)), "c"])


class Gathered:
    """Counts of runs of word keys, combined over slices as long as they fit ``limit`` runs."""

    def __init__(self, columns: int, limit: int = 1 << 18) -> None:
        self.columns, self.limit, self.parts, self.size = columns, limit, [], 0

    def add(self, key: np.ndarray, runs: list[np.ndarray], c: np.ndarray) -> None:
        self.parts.append((key, runs, c))
        self.size += len(c)

    def batches(self, last: bool = False) -> Iterator:
        """What has to leave: everything at the end, or when combining no longer helps."""
        if not self.parts or not last and self.size <= self.limit:
            return
        keys, runs, counts = zip(*self.parts)
        key, parts, c = np.concatenate(keys), [np.concatenate(p) for p in zip(*runs)], np.concatenate(counts)
        at, c = counted(key, parts, c)
        self.parts, self.size = [(key[at], [p[at] for p in parts], c)], len(c)
        if last or self.size > self.limit // 2:
            yield _batch(self.parts[0][1], c, self.columns)
            self.parts, self.size = [], 0


def _count_words(batches):
    import pyarrow as pa

    for words, salt, langs in _slices(batches):
        key = mixed(words.keys ^ salt)
        other = word_keys(words.joined ^ np.uint8(0xFF), words.starts, words.ends)
        at, c = counted(key, [other, salt])
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(words.rows[at])), text_array(words.joined, words.starts[at], words.ends[at]), pa.array(key[at].view(np.int64)), pa.array(c)],
            ["lang", "word", "key", "c"],
        )


def _count_runs(shared: list[Shared], widths: list[int]):
    """Runs of words whose shorter runs are frequent as far as the bitmaps tell.

    ``shared`` are the bitmaps of words, pairs and so on; a run is counted if all its runs
    of the longest width with a bitmap are marked.
    """

    def run(batches):
        bits = [s.get() for s in shared]
        known, held = len(bits), {m: Gathered(max(widths)) for m in widths if m > 3}  # longer ones are few, and much the same
        for words, salt, _ in _slices(batches):
            one = mixed(words.keys ^ salt)
            n = len(one)
            good = _marked(bits[0], one)
            for m, bitmap in enumerate(bits[1:], start=2):  # places where m words in a row may be frequent
                good = good[: n - m + 1] & good[1 : n - m + 2] & (words.run[: n - m + 1] >= m) if n >= m else good[:0]
                at = np.flatnonzero(good)
                good[at] = _marked(bitmap, grams(one, at, m))
            for m in widths:
                alive = words.run[: n - m + 1] >= m if n >= m else np.zeros(0, dtype=bool)
                for j in range(m - known + 1):
                    alive = alive & good[j : j + len(alive)]
                at = np.flatnonzero(alive)
                key, parts = grams(one, at, m), [one[at + j] for j in range(m)]
                first, c = counted(key, parts)
                parts = [p[first] for p in parts]
                if m in held:
                    held[m].add(key[first], parts, c)
                    yield from held[m].batches()
                else:
                    yield _batch(parts, c, max(widths))
        for rest in held.values():
            yield from rest.batches(last=True)

    return run


def _run_key(width: int):
    """The same key of a run as in :func:`_count_runs`, for its bit."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            words = lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), width)
            key = grams(words.reshape(-1), np.arange(0, words.size, width), width)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return run


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """A bit for the low bits of each ``key``; at most ``2 ** (bits - 3)`` bytes come to the driver."""
    at = F.pmod("key", F.lit(1 << bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in parts:
        piece = np.frombuffer(row["bits"], dtype=np.uint8)
        begin = (row["part"] - 1) * len(piece)
        out[begin : begin + len(piece)] = piece[: len(out) - begin]
    return out.tobytes()


def _from_bytes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint8)


def _huge(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 5,
    min_count: int = 100,
    top: int = 2000,
    subsume_percent: int = 100,
    missing: str = "und",
    bits: int = BITS,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z is lower-cased; texts are split into pieces at ``.,;:!?`` and line breaks, and pieces
    into words at spaces and tabs.  Phrases are runs of 2 to ``max_words`` words within a piece
    that occur ``min_count`` times or more in a language (overlaps count).  A phrase cut in two
    has the score ``1000 * a * n / (l * r)`` rounded down, with the counts of the phrase,
    of all words and of both parts; its lowest cut counts.  A phrase inside a longer one
    with at least ``subsume_percent`` of its count is dropped.  Each language has ``top``
    ranks by score, count and phrase in byte order.

    **Stripes.**  Under each prefix of words there is a counter of the words that follow, as
    cells (prefix, next word, count).  Stripes of slices of text are merged by adding equal
    cells, so no task holds the whole stripe of a prefix.  A cell is the count of that
    phrase and the total of the stripe whose prefix is that phrase, which gives the counts
    of parts.  The largest cell in the stripe of a phrase, and the largest cell of a
    phrase that has it as its end, are the largest counts of longer phrases by one
    word; since longer phrases never occur more often, no other has to be looked at.

    Shorter runs prune longer ones: pairs are counted where both words are frequent, triples
    where both pairs are, longer phrases where all triples are.  That is told by bitmaps
    of ``2 ** bits`` bits, broadcast (eight megabytes each by default); a bit may stand
    for several runs, which costs work but no result.  Words travel as 64-bit keys of word
    and language; should two frequent words share one, the call ends with an error.

    A null language is ``missing``, a null text empty.  Texts of any length are worked on
    whole, in slices of texts of about a megabyte.  Repeated rows count again; ties
    in score and count go to the phrase that sorts first, ties of cuts to the shorter
    first part.  An empty table gives an empty result.  Further columns are not read.
    Arithmetic is in decimals of 38 digits.
    """
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    spark = docs.sparkSession
    given = docs.select(F.coalesce(column(lang).cast("string"), F.lit(missing)).alias("lang"), F.concat(column(text), F.lit("\n")).alias("text")).where("text IS NOT NULL")
    often = F.col("c") >= min_count
    every = given.mapInArrow(_count_words, "lang string, word string, key bigint, c bigint").groupBy("lang", "word", "key").agg(F.sum("c").alias("c"))
    every = stage(every, "phrase-words")
    totals = stage(every.groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
    words = stage(every.where(often), "phrase-frequent-words")
    discard(every)
    if not words.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError("two frequent words share a key")
    shared, levels = [Shared(spark, _bitmap(words, bits), _from_bytes)], []
    for widths in ([2], [3], list(range(4, max_words + 1))):
        widths = [m for m in widths if m <= max_words]
        if widths:
            names = [f"w{i + 1}" for i in range(widths[-1])]
            schema = ", ".join(f"{c} bigint" for c in [*names, "c"])
            runs = given.mapInArrow(_count_runs(shared, widths), schema).groupBy(*names).agg(F.sum("c").alias("c")).where(often)
            levels.append(stage(runs.select(F.array_compact(F.array(*names)).alias("w"), "c"), "phrase-runs"))
            if widths[-1] < min(max_words, 4):
                keys = levels[-1].select("w").mapInArrow(_run_key(widths[0]), "key bigint")
                shared.append(Shared(spark, _bitmap(keys, bits), _from_bytes))
    for s in shared:
        s.end()
    cells = words.select(F.array("key").alias("w"), "c")
    for level in levels:
        cells = cells.unionAll(level)
    # the largest count of a phrase that is longer by one word, to the right or to the left
    m = F.size("w")
    longer = cells.where(m > 1)
    prefix, end = F.slice("w", F.lit(1), m - 1), F.slice("w", F.lit(2), m - 1)
    most = longer.select(prefix.alias("w"), "c").unionAll(longer.select(end.alias("w"), "c")).groupBy("w").agg(F.max("c").alias("most"))
    # staged, as below, so that joins are of two shuffles, which Spark splits where a key is hot
    most = stage(most, "phrase-longer")
    free = longer.join(most, "w", "left").where(F.col("most").isNull() | (_huge(F.col("most")) * 100 < _huge(F.col("c")) * subsume_percent))
    free = stage(free.select(F.monotonically_increasing_id().alias("id"), "w", F.col("c").alias("a")), "phrase-free")
    spelled = free.select("id", F.posexplode("w").alias("i", "key")).join(words.select("key", "lang", "word"), "key")
    spelled = spelled.groupBy("id").agg(
        F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )  # at most max_words rows each
    spelled = stage(spelled, "phrase-texts")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cuts = cuts.select("id", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, m).alias("rest"))
    cuts = stage(cuts.join(cells.select(F.col("w").alias("head"), F.col("c").alias("l")), "head").drop("head"), "phrase-heads")
    cuts = cuts.join(cells.select(F.col("w").alias("rest"), F.col("c").alias("r")), "rest").drop("rest").join(spelled, "id").join(totals, "lang")
    score = F.expr("(1000 * CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task sees all phrases of one
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
