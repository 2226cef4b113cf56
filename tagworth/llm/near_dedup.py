"""Near duplicates: SuperMinHash signatures, bands, exact check and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, digest, discard, stage
from .graph import components
from .tokens import LOWER, buffer_of, mixed, shingles, word_keys, word_spans

BANDS, ROWS = 28, 3
SLICE = 2 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of this similarity share no band."""
    return (1 - similarity**rows) ** bands


def superminhash(keys: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (rows x slots) of many sets at once.

    Every element draws a random order of the slots.  In round j it offers j plus a random
    fraction to the j-th slot of its order, and a slot keeps the smallest offer.  A set
    is done as soon as every slot holds an offer of a round already played, since later
    offers are larger; only elements of open sets go on.  The orders are drawn as needed,
    by swaps.  Rows without elements keep the largest value.
    """
    n_rows = len(counts)
    best = np.full(n_rows * slots, np.uint64(2**64 - 1), dtype=np.uint64)
    rows = np.repeat(np.arange(n_rows), counts)
    order = None
    for j in range(slots):
        with np.errstate(over="ignore"):
            z = mixed(keys + _GOLD * np.uint64(j + 1))
        pick = (((z >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        offer = (z & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        if order is None:
            slot = pick
        else:
            at = np.arange(len(keys))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
        np.minimum.at(best, rows * slots + slot, offer)
        open_ = (best.reshape(n_rows, slots) >= np.uint64((j + 1) << 32)).any(axis=1)
        stay = open_[rows]
        if not stay.any():
            break
        if order is None:
            keys, rows, first = keys[stay], rows[stay], pick[stay]
            order = np.tile(np.arange(slots, dtype=np.int16), (len(keys), 1))
            order[np.arange(len(keys)), first] = 0
        elif stay.mean() < 0.7:
            keys, rows, order = keys[stay], rows[stay], order[stay]
    return best.reshape(n_rows, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        out = mixed(out ^ parts[:, :, r]) + np.uint64(r)
    return out


def _sets(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shingle keys and counts of an Arrow text column, in slices of bounded size."""
    raw, at = buffer_of(texts)
    for i, j in byte_slices(np.diff(at), SLICE):
        part, where = LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
        starts, ends, rows = word_spans(part, where)
        keys, counts = shingles(word_keys(part, starts, ends), rows, j - i)
        yield i, j, keys, counts


def _distinct(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(counts)])
    return [np.unique(keys[edges[r] : edges[r + 1]]) for r in range(len(counts))]


def _set_name(keys: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sign(bands: int, rows: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, keys, counts in _sets(batch.column("text")):
                sets = _distinct(keys, counts)
                names = [_set_name(s) for s in sets]
                signed = band_keys(superminhash(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.array([len(s) for s in sets]), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * bands + 1, bands, dtype=np.int32)), pa.array(signed.reshape(-1).view(np.int64)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("id", "t1", "t2")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([n[0] for n in names], pa.int64()),
                        pa.array([n[1] for n in names], pa.int64()),
                        lists,
                    ],
                    ["id", "t1", "t2", "n", "d1", "d2", "bands"],
                )

    return run


def _collect_sets(batches):
    import pyarrow as pa

    for batch in batches:
        for i, j, keys, counts in _sets(batch.column("text")):
            sets = _distinct(keys, counts)
            names = [_set_name(s) for s in sets]
            edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("cid"),
                    pa.array([n[0] == a and n[1] == b for n, a, b in zip(names, part.column("d1").to_pylist(), part.column("d2").to_pylist())]),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))),
                ],
                ["cid", "same", "keys"],
            )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose full sets are similar enough."""
    one = sets.select(F.col("cid").alias("a"), F.col("keys").alias("ka"))
    two = sets.select(F.col("cid").alias("b"), F.col("keys").alias("kb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", F.size("ka").alias("na"), F.size("kb").alias("nb"), F.size(F.array_intersect("ka", "kb")).alias("both"))
    return both.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _fits(a: str, b: str, percent: int):
    """The smaller set is large enough for the similarity at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _open_members(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Bucket members with their component, of buckets that hold more than one component."""
    if found is None:
        return members.withColumn("c", F.col("cid"))
    named = members.join(found, members["cid"] == found["node"], "left").select("key", "cid", "n", "weight", F.coalesce("root", "cid").alias("c"))
    named = stage(named, "near-named-members")
    mixed_ = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    # staged, as other tables below that a hot key joins: only a join of two shuffles is split
    return named.join(stage(mixed_, "near-mixed"), "key", "left_semi")


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes under one key that lie in different components and fit in size.

    Members outside the largest component of a key are paired with all members, so a
    component costs nothing within itself.
    """
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("n_c")).groupBy("key").agg(F.max_by("c", F.struct("n_c", "c")).alias("big"))
    outside = rows.join(sizes, "key").where("c <> big").select("key", F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    pairs = outside.join(rows, "key").where((F.col("cx") != F.col("c")) & _fits("nx", "n", percent))
    return pairs.select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b"))


def _block_links(rows: DataFrame, percent: int, block: int = 200_000) -> DataFrame:
    """Links across components under one key, found block by block.

    Members outside the largest component of a key, and all its members, are dealt into
    blocks of some ``block`` shingles; every pair of blocks is a group of its own, in which
    sets are compared in numpy.  Union-find over the components of a group, as they are
    known so far, leaves out comparisons inside one and lets only a spanning forest out:
    fewer links than components.  Blocks bound the memory of a group and spread a large
    key over many tasks.
    """
    sizes = rows.groupBy("key", "c").agg(F.sum("n").alias("t")).groupBy("key").agg(F.max_by("c", F.struct("t", "c")).alias("big"), F.sum("t").alias("all"), F.max("t").alias("most"))
    sizes = sizes.select("key", "big", F.ceil(F.col("all") / block).alias("n_right"), F.ceil((F.col("all") - F.col("most")) / block).alias("n_left")).where("n_left > 0")
    sizes = stage(sizes, "near-blocks")
    dealt = rows.join(sizes, "key")

    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = dealt.where("c <> big").select("key", F.pmod(F.xxhash64("cid"), "n_left").alias("i"), numbers("n_right").alias("j"), "cid", "c", "keys")
    right = dealt.select("key", numbers("n_left").alias("i"), F.pmod(F.xxhash64("cid"), "n_right").alias("j"), "cid", "c", "keys")

    def compare(x, y):
        import pyarrow as pa

        def parts(t, mark):
            lists = t.column(mark + "keys").combine_chunks()
            return t.column(mark + "cid").to_numpy(), t.column(mark + "c").to_numpy(), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())

        (xi, xc, xk, xn), (yi, yc, yk, yn) = parts(x, "x_"), parts(y, "y_")
        a, b = [], []
        if len(xi) and len(yi):
            known = np.unique(xk)
            code = np.minimum(np.searchsorted(known, yk), len(known) - 1)
            code[known[code] != yk] = len(known)
            begin = np.concatenate([[0], np.cumsum(yn)])[:-1]
            edges = np.concatenate([[0], np.cumsum(xn)])
            names = np.unique(np.concatenate([xc, yc]))
            px, py = np.searchsorted(names, xc), np.searchsorted(names, yc)
            root = np.arange(len(names))  # of each component, as far as it is joined here
            for k in range(len(xi)):
                apart = root[py] != root[px[k]]
                if not apart.any():
                    continue
                held = np.zeros(len(known) + 1, dtype=np.int32)
                held[np.searchsorted(known, xk[edges[k] : edges[k + 1]])] = 1
                both = np.add.reduceat(held[code], begin)
                hit = np.flatnonzero(apart & (both * 100 >= (xn[k] + yn - both) * percent))
                if len(hit):  # one link to each component that is new to this one
                    joined, one = np.unique(root[py[hit]], return_index=True)
                    a.append(np.full(len(joined), xi[k]))
                    b.append(yi[hit[one]])
                    root[np.isin(root, joined)] = root[px[k]]
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([*a, none]), pa.int64()), "b": pa.array(np.concatenate([*b, none]), pa.int64())})

    at = ["key", "i", "j"]
    left, right = (side.select(*[F.col(c).alias(mark + c) for c in side.columns]) for mark, side in (("x_", left), ("y_", right)))
    return left.groupBy(*["x_" + c for c in at]).cogroup(right.groupBy(*["y_" + c for c in at])).applyInArrow(compare, "a bigint, b bigint")


def class_links(sets: DataFrame, members: DataFrame, percent: int, stars: int = 2, small: int = 32) -> DataFrame | None:
    """``node, root`` of classes that are linked with another.

    In a bucket of a band, members are first compared with one of them, that which meets
    most others over all its bands and so lies in the middle of its group: a star of
    pairs, ``stars`` times around other such members.  Members that fall into one component
    need no comparison with each other.  What is left is compared across components:
    within buckets of at most ``small`` members pair by pair, in larger ones block by block
    (:func:`_block_links`).  So every linked pair of a bucket is compared or already connected,
    while a large group of near copies gives some pairs per member, not all pairs.
    """
    found = None
    for turn in range(stars + 1):
        open_ = stage(_open_members(members, found), "near-open")
        if open_.isEmpty():
            break
        if turn < stars:
            chance = F.pmod(F.xxhash64(F.lit(turn), "cid"), F.lit(1000)) / 1000
            rank = F.col("weight") * (1 if turn == 0 else 0.8 + 0.2 * chance)
            first = F.struct(rank.alias("r"), F.col("cid").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"))
            heads = stage(open_.groupBy("key").agg(F.max(first).alias("s")).select("key", "s.x", "s.cx", "s.nx"), "near-heads")
            pairs = open_.join(heads, "key").where((F.col("cx") != F.col("c")) & _fits("nx", "n", percent)).select(F.col("x").alias("a"), F.col("cid").alias("b"))
        else:
            large = stage(open_.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > small).select("key"), "near-large")
            few = open_.join(large, "key", "left_anti").select("key", "cid", "n", "c")
            many = stage(open_.join(large, "key", "left_semi").select("key", "cid", "n", "c"), "near-many")
            pairs = _cross_pairs(few, percent)
        links = _verified(pairs.distinct(), sets, percent)
        if turn == stars:
            links = links.unionAll(_block_links(many.join(sets, "cid"), percent))
        links = stage(links, "near-links")
        known = links if found is None else links.unionAll(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
        found = components(known)
        discard(open_, links)
    return found


def near_dedup(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 75, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are similar.

    Words are runs without ASCII white space, A-Z lower-cased.  SuperMinHash signatures of
    ``bands * rows`` slots are cut into bands; documents that agree in a band are
    candidates, and a link needs a Jaccard similarity of ``percent`` or more on the full
    sets.  Groups are the connected components of the links.  At a similarity of 0.75
    a pair shares no band with a probability of 2e-7.

    Result per input row: ``doc_id, n_shingles, component_id`` (smallest id reachable),
    ``kept`` (the id is the component's), ``first_row`` (true for exactly one row of a
    component) and ``t1, t2``, a hash of the text.  A text of fewer than five words has
    its whole sequence as its only shingle; a text without words, or null, has none and
    is linked with nothing.  A missing id is never the smallest while another exists.
    Repeated rows are in one group.  An empty table gives an empty result; further
    columns are not read.

    Rows with the same set are one class, whose members are never paired.  Signatures are
    staged (some 250 bytes a row); texts are shuffled once, to gather the sets of classes
    that share a band with another.  Texts are worked on in slices of two megabytes.
    """
    t1, t2 = digest(F.coalesce(text, F.lit("")))
    given = docs.select(F.col(doc_id).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    signed = given.mapInArrow(_sign(bands, rows), f"id {kind}, t1 bigint, t2 bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")
    signed = stage(signed.withColumn("rid", F.monotonically_increasing_id()), "near-signed")
    low = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    classes = (
        signed.where("n > 0")
        .groupBy("d1", "d2", "n")
        .agg(F.min(low).alias("low"), F.min_by(F.struct("rid", "id", "t1", "t2", "bands"), "rid").alias("rep"))
        .select("d1", "d2", "n", "low", F.col("rep.rid").alias("cid"), F.col("rep.id").alias("rep_id"), F.col("rep.t1").alias("r1"), F.col("rep.t2").alias("r2"), "rep.bands")
    )
    classes = stage(classes, "near-classes")
    banded = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-shared")
    in_shared = banded.join(shared, "key")
    weights = in_shared.groupBy("cid").agg(F.sum("m").alias("weight"))
    members = stage(in_shared.drop("m").join(weights, "cid"), "near-members")
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "d1", "d2", "rep_id", "r1", "r2")
    texts = given.join(
        wanted, given["id"].eqNullSafe(wanted["rep_id"]) & (given["t1"] == wanted["r1"]) & (given["t2"] == wanted["r2"])
    ).select("cid", "d1", "d2", "text")
    sets = texts.mapInArrow(_collect_sets, "cid bigint, same boolean, keys array<bigint>").where("same").dropDuplicates(["cid"]).select("cid", "keys")
    sets = stage(sets, "near-sets")
    found = class_links(sets, members, percent)
    discard(sets, members)
    rooted = classes.select("cid", "d1", "d2", "n", "low") if found is None else classes.join(found, classes["cid"] == found["node"], "left").select("cid", "d1", "d2", "n", "low", "root")
    root = F.col("cid") if found is None else F.coalesce("root", "cid")
    rooted = stage(rooted.withColumn("c", root), "near-rooted")
    firsts = rooted.groupBy("c").agg(F.min("low").alias("first"))
    named = stage(rooted.join(firsts, "c").select("d1", "d2", "n", F.col("first.id").alias("component_id"), F.col("first.rid").alias("first_rid")), "near-named")
    own = signed.select("rid", "id", "t1", "t2", "n", "d1", "d2")
    out = own.join(named, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        (F.col("rid") == F.coalesce("first_rid", "rid")).alias("first_row"),
        "t1",
        "t2",
    )


def one_per_group(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; columns as they are.

    Rows without words stay.  Rows with the same id and text are one document.
    """
    marks = near_dedup(docs, text=text, doc_id=doc_id, **settings)
    marks = stage(marks.groupBy("doc_id", "t1", "t2").agg(F.max("first_row").alias("stays"), F.max("n_shingles").alias("n"), F.count("*").alias("times")), "near-marks")
    t1, t2 = digest(F.coalesce(text, F.lit("")))
    left = docs.select(F.struct(*docs.columns).alias("row"), t1.alias("l1"), t2.alias("l2"))
    keys = marks.where("stays").select(F.col("doc_id").alias("m_id"), "t1", "t2", "n")
    both = left.join(keys, F.col("row")[doc_id].eqNullSafe(F.col("m_id")) & (F.col("l1") == F.col("t1")) & (F.col("l2") == F.col("t2")))
    if marks.where("times > 1 AND n > 0").isEmpty():
        return both.select("row.*")
    again = F.when(F.col("n") > 0, F.lit(0)).otherwise(F.monotonically_increasing_id())
    return both.withColumn("again", again).groupBy("m_id", "l1", "l2", "again").agg(F.first("row").alias("row")).select("row.*")
