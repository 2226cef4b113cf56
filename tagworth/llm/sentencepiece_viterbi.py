"""Encoding with the pieces of a SentencePiece model, and decoding, in numpy."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from .common import Shared, byte_slices
from .tokens import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # the mark that stands for a space in pieces
PENALTY = 10.0  # an unknown character scores this much less than the worst piece
SLICE = 2_000_000
LONGEST = 64  # longer words are segmented one by one
ROWS = 20_000
_B = 0x9E3779B97F4A7C15
_OTHER = 0xFFFFFFFE  # a literal mark in the text: no piece has it


def load_pieces(path: str = MODEL) -> list[tuple[str, float, int]]:
    """Piece, log probability and kind of each id, read on the driver.

    A unigram model holds log probabilities.  A BPE model holds the negative rank of the
    merge that made a piece; the rank is turned into a probability in proportion to
    1 / (rank + 1), as word frequencies fall by Zipf's law.  Pieces outside the ranking
    (runs of spaces) rank last.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if not (model.normalizer_spec.add_dummy_prefix and model.normalizer_spec.escape_whitespaces and not model.normalizer_spec.remove_extra_whitespaces):
        raise ValueError("only models that keep white space and add a space in front are read")
    if model.trainer_spec.model_type == 1:
        return [(p.piece, p.score, p.type) for p in model.pieces]
    n = len(model.pieces)
    return [(p.piece, -math.log(min(-p.score, n) + 1), p.type) for p in model.pieces]


def _cps(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hash_rows(points: np.ndarray) -> np.ndarray:
    """Prefix polynomials of the rows of a matrix of code points, one column more."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(points.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(_B) + points[:, i] + np.uint64(1)
    return out


class Pieces:
    """The pieces as sorted keys per length, with scores and ids."""

    def __init__(self, pieces: Sequence[tuple[str, float, int]], merges: bool = False) -> None:
        self.merges = merges
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)]
        if any(SPACE in p[1:] and p.strip(SPACE) for _, p, _ in normal):
            raise ValueError("a piece has a space behind another character: words cannot be cut apart")
        bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if len(bytes_) != 256:
            raise ValueError("the model has no byte pieces, so unknown characters cannot be restored")
        self.byte_ids = np.array([bytes_[b] for b in range(256)], dtype=np.int32)
        self.unknown = min(s for _, _, s in normal) - PENALTY
        self.by_text = {p: (i, s) for i, p, s in normal}
        self.longest = max(len(p) for _, p, _ in normal)
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = [(i, p, s) for i, p, s in normal if len(p) == n]
            if own:
                points = np.stack([_cps(p) for _, p, _ in own])
                keys = mixed(_hash_rows(points)[:, -1])
                order = np.argsort(keys)
                self.tables[n] = (
                    keys[order],
                    np.array([s for _, _, s in own])[order],
                    np.array([i for i, _, _ in own], dtype=np.int32)[order],
                    points[order],
                )
        texts = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(SPACE, " ").encode() if kind in (1, 4) else b"" for p, _, kind in pieces]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    # --- encoding ------------------------------------------------------------------------

    def _probe(self, points: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Score and id of every substring, by length; minus infinity where it is no piece."""
        upto = _hash_rows(points)
        out = {}
        for n, (keys, scores, ids, texts) in self.tables.items():
            width = points.shape[1] - n + 1
            if width < 1:
                continue
            with np.errstate(over="ignore"):
                sub = mixed(upto[:, n:] - upto[:, :-n] * np.uint64(pow(_B, n, 1 << 64)))
            at = np.minimum(np.searchsorted(keys, sub.reshape(-1)), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == sub.reshape(-1))
            row, col = hit // width, hit % width
            same = np.ones(len(hit), dtype=bool)  # keys are hashes: compare the characters
            for k in range(n):
                same &= points[row, col + k] == texts[at[hit], k]
            score = np.full(len(at), -np.inf)
            score[hit[same]] = scores[at[hit[same]]]
            out[n] = (score.reshape(-1, width), ids[at].reshape(-1, width))
        return out

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of words of one length: flat ids (-1 - character if unknown), counts.

        At each place the candidates of all lengths are one matrix, longest first; the
        first maximum of a row is stored as its backpointer.
        """
        rows, length = points.shape
        found = self._probe(points)
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        step = np.zeros((rows, length + 1), dtype=np.int8)
        which = np.zeros((rows, length + 1), dtype=np.int64)
        every = np.arange(rows)
        lone = found[1][0] if 1 in found else np.full((rows, length), -np.inf)
        lone = np.where(np.isneginf(lone), self.unknown, lone)
        for j in range(1, length + 1):
            sizes = [n for n in sorted(found, reverse=True) if 1 < n <= j] + [1]
            ways = np.stack([best[:, j - n] + (lone if n == 1 else found[n][0])[:, j - n] for n in sizes], axis=1)
            pick = ways.argmax(axis=1)
            best[:, j] = ways[every, pick]
            step[:, j] = np.array(sizes, dtype=np.int8)[pick]
            ids = np.stack([found[n][1][:, j - n] if n in found else np.zeros(rows, np.int32) for n in sizes], axis=1)[every, pick]
            absent = np.isneginf(found[1][0][:, j - 1]) if 1 in found else np.ones(rows, bool)
            which[:, j] = np.where((step[:, j] == 1) & absent, -1 - points[:, j - 1].astype(np.int64), ids)
        path, at = [], np.full(rows, length)
        while (at > 0).any():
            path.append(np.where(at > 0, which[every, at], np.iinfo(np.int64).min))
            at = at - np.where(at > 0, step[every, at], 0)
        path = np.stack(path[::-1], axis=1)
        real = path != np.iinfo(np.int64).min
        return path[real], real.sum(axis=1)

    def one_word(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a single long word."""
        text = "".join(chr(c) if c < 0x110000 else "\x00" for c in points.tolist())
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                hit = None if points[i] == _OTHER or points[j - 1] == _OTHER else self.by_text.get(text[i:j])
                if hit is None and j - i > 1:
                    continue
                ident, score = hit or (-1 - int(points[i]), self.unknown)
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, ident)
        path, j = [], n
        while j:
            j, ident = back[j]
            path.append(ident)
        return np.array(path[::-1], dtype=np.int64), np.array([len(path)])

    def merged(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length by the merges of a BPE model, with the form of :meth:`viterbi`.

        All words take one step at a time: of the neighbours whose union is a piece, the
        best-ranked and then leftmost are joined, until a word has none.
        """
        rows, length = points.shape
        found = self._probe(points)
        score = np.full((length + 1, rows, length), -np.inf)
        ident = np.zeros((length + 1, rows, length), dtype=np.int64)
        for n, (values, ids) in found.items():
            score[n, :, : length - n + 1], ident[n, :, : length - n + 1] = values, ids
        end = np.tile(np.arange(1, length + 1), (rows, 1))
        alive = np.ones((rows, length), dtype=bool)
        every, starts = np.arange(rows)[:, None], np.arange(length)[None, :]
        while True:
            last = end >= length
            after = end[every, np.minimum(end, length - 1)]
            gain = np.where(alive & ~last, score[after - starts, every, starts], -np.inf)
            pick = gain.argmax(axis=1)
            go = np.flatnonzero(gain[np.arange(rows), pick] > -np.inf)
            if not len(go):
                break
            i, j = pick[go], end[go, pick[go]]
            end[go, i], alive[go, j] = end[go, j], False
        size = end - starts
        ids = ident[size, every, starts]
        unknown = np.isneginf(score[size, every, starts])
        return np.where(unknown, -1 - points.astype(np.int64), ids)[alive], alive.sum(axis=1)

    def one_merged(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a single long word, with a queue of possible merges."""
        text = "".join(chr(c) if c < 0x110000 and c != _OTHER else "\x00" for c in points.tolist())
        n = len(text)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        dead = [False] * n
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if i >= 0 and j < n and end[j] - i <= self.longest:
                hit = self.by_text.get(text[i : end[j]])
                if hit is not None:
                    heapq.heappush(queue, (-hit[1], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, k = heapq.heappop(queue)
            if dead[i] or dead[j] or end[i] != j or end[j] != k:
                continue
            end[i], dead[j] = k, True
            if k < n:
                before[k] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        path = []
        for i in range(n):
            if not dead[i]:
                hit = self.by_text.get(text[i : end[i]])
                path.append(hit[0] if hit is not None and points[i] != _OTHER else -1 - int(points[i]))
        return np.array(path, dtype=np.int64), np.array([len(path)])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their counts.

        A text gets a space in front; spaces become the mark of pieces.  Words start at a
        mark that follows another character; each different word is segmented once.
        """
        points = _cps("".join(" " + t if t else "" for t in texts)).copy()
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points[points == ord(SPACE)] = _OTHER
        points[points == 0x20] = ord(SPACE)
        space = points == ord(SPACE)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        begin[edges[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(points)))
        word_row = np.searchsorted(edges, starts, side="right") - 1
        first, inverse = self._unique(points, starts, lengths)
        ids, counts = self._segment(points, starts[first], lengths[first])
        offset = np.concatenate([[0], np.cumsum(counts)])
        n = counts[inverse]
        at = np.repeat(offset[inverse] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
        per_row = np.bincount(word_row, weights=n, minlength=len(texts)).astype(np.int64)
        return ids[at], per_row

    @staticmethod
    def _unique(points, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """First place of each different word, and for each word the number of its first."""
        with np.errstate(over="ignore"):
            spread = mixed(points.astype(np.uint64) + np.uint64(1))
            within = np.arange(len(points)) - np.repeat(starts, lengths)
            key = np.add.reduceat(mixed(spread + within.astype(np.uint64) * np.uint64(_B)), starts)
            key = mixed(key ^ lengths.astype(np.uint64))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        rep = first[inverse]
        bad = lengths != lengths[rep]
        if not bad.any():  # keys are hashes: compare the characters
            at = np.repeat(starts[rep], lengths) + within
            bad = np.logical_or.reduceat(points[at] != points, starts)
        if bad.any():
            extra = np.flatnonzero(bad)
            inverse = inverse.copy()
            inverse[extra] = len(first) + np.arange(len(extra))
            first = np.concatenate([first, extra])
        return first, inverse

    def _segment(self, points, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words; words of equal length advance together."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, bounds):
            n = int(lengths[group[0]])
            if n > LONGEST:
                for w in group:
                    alone = self.one_merged if self.merges else self.one_word
                    parts.append((np.array([w]), *alone(points[starts[w] : starts[w] + n])))
                continue
            for k in range(0, len(group), ROWS):
                some = group[k : k + ROWS]
                matrix = points[starts[some][:, None] + np.arange(n)]
                parts.append((some, *(self.merged(matrix) if self.merges else self.viterbi(matrix))))
        words = np.concatenate([p[0] for p in parts])
        flat = np.concatenate([p[1] for p in parts])
        counts = np.concatenate([p[2] for p in parts])
        flat, counts = self._with_bytes(flat, counts)
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
        back = np.argsort(words)
        n = counts[back]
        at = np.repeat(begin[back] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
        return flat[at].astype(np.int32), n

    def _with_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as the byte pieces of their UTF-8 form."""
        lost = np.flatnonzero(flat < 0)
        if not len(lost):
            return flat, counts
        kinds, inverse = np.unique(-1 - flat[lost], return_inverse=True)
        forms = [self.byte_ids[list((SPACE if c == _OTHER else chr(int(c))).encode("utf-8", "surrogatepass"))] for c in kinds]
        size = np.ones(len(flat), dtype=np.int64)
        size[lost] = np.array([len(f) for f in forms])[inverse]
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(begin[-1]), dtype=np.int64)
        known = np.flatnonzero(flat >= 0)
        out[begin[known]] = flat[known]
        for k, form in enumerate(forms):
            at = begin[lost[inverse == k]]
            for i, b in enumerate(form):
                out[at + i] = b
        edges = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(begin[edges])

    # --- decoding ------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of id sequences: bytes of all pieces, without the space in front."""
        n = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(int(ends[-1]))
        raw = self.raw[at].tobytes() if len(at) else b""
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def _slices(column):
    texts = column.to_pylist()
    for i, j in byte_slices([len(t or "") for t in texts], SLICE):
        yield i, j, texts[i:j]


def _cut(text: str) -> list[str]:
    """A very long text as parts that can be encoded one after the other."""
    parts, i = [], 0
    while len(text) - i > SLICE:
        j = text.rfind(" ", i + 1, i + SLICE)
        while j > 0 and text[j - 1] == " ":  # the run of spaces stays whole
            j -= 1
        if j <= i:
            break
        parts.append(text[i:j])
        i = j
    return [*parts, text[i:]]


def _encoded(pieces: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    if len(texts) == 1 and texts[0] and len(texts[0]) > SLICE:
        first, *rest = _cut(texts[0])
        flat = [pieces.encode([first])[0]]
        for part in rest:  # each starts with a space, which serves as the space in front
            flat.append(pieces.encode([part[1:]])[0] if part.startswith(" ") and len(part) > 1 else pieces.encode([part])[0])
        ids = np.concatenate(flat)
        return ids, np.array([len(ids)])
    return pieces.encode(texts)


def encode(docs: DataFrame, *, text: str = "text", path: str = MODEL, ids: str = "ids", merges: bool = False) -> DataFrame:
    """``docs`` with the piece ids of ``text`` as the array column ``ids``.

    The segmentation is the one with the highest sum of piece scores, as SentencePiece
    defines it for its unigram models; of equal ones that with the longest last piece.
    With ``merges`` it is that of SentencePiece's BPE models, for vocabularies of that kind.
    Characters that no piece has become the byte pieces of their UTF-8 form, so decoding
    restores every text.  Null stays null, the empty text has no ids.  A column named
    like ``ids`` is replaced; other columns stay.  Nothing is shuffled: the piece table
    (its size is that of the vocabulary) is broadcast, and texts are worked on in slices.
    """
    base = docs.select([c for c in docs.columns if c != ids])
    shared = Shared(docs.sparkSession, load_pieces(path), functools.partial(Pieces, merges=merges))
    names = base.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(names.index(text))
            for i, j, part in _slices(column):
                flat, counts = _encoded(shared.get(), part)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(t is None for t in part), False])), pa.array(flat, pa.int32())
                )
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lists], [*names, ids])

    return base.mapInArrow(run, StructType(list(base.schema.fields)).add(ids, ArrayType(IntegerType())))


def decode(docs: DataFrame, *, ids: str = "ids", path: str = MODEL, text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the id arrays in ``ids``; null stays null."""
    base = docs.select([c for c in docs.columns if c != text])
    shared = Shared(docs.sparkSession, load_pieces(path), Pieces)
    names = base.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(names.index(ids))
            sizes = [len(x) if x.is_valid else 0 for x in column]
            for i, j in byte_slices(sizes, SLICE // 4):
                part = column.slice(i, j - i)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = shared.get().decode(flat, np.array(sizes[i:j], dtype=np.int64))
                texts = [t if v else None for t, v in zip(texts, part.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(texts, pa.string())], [*names, text])

    from pyspark.sql.types import StringType

    return base.mapInArrow(run, StructType(list(base.schema.fields)).add(text, StringType()))


def encoded_and_checked(
    docs: DataFrame, *, text: str = "text", path: str = MODEL, ids: str = "ids", count: str = "n_tokens", same: str = "round_trip", merges: bool = False
) -> DataFrame:
    """Ids, their number, and whether decoding them gives the text again, in one pass.

    The text itself is not in the result; the other columns are.  ``same`` is null where
    the text is null, and ``count`` is 0 there.
    """
    base = docs.select([c for c in docs.columns if c not in (ids, count, same)])
    shared = Shared(docs.sparkSession, load_pieces(path), functools.partial(Pieces, merges=merges))
    names = base.columns
    rest = [c for c in names if c != text]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, part in _slices(batch.column(names.index(text))):
                flat, counts = _encoded(shared.get(), part)
                back = shared.get().decode(flat, counts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(t is None for t in part), False])), pa.array(flat, pa.int32())
                )
                rows = batch.slice(i, j - i)
                ok = pa.array([None if t is None else t == b for t, b in zip(part, back)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(rows.column(names.index(c)) for c in rest), lists, pa.array(counts, pa.int64()), ok], [*rest, ids, count, same])

    fields = [f for f in base.schema.fields if f.name != text]
    schema = StructType(fields).add(ids, ArrayType(IntegerType())).add(count, LongType()).add(same, BooleanType())
    return base.mapInArrow(run, schema)
