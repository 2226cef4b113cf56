"""Words and word shingles of many texts at once, in numpy.

Texts of a batch are one array of bytes; ASCII white space separates words, so words can
be found without decoding UTF-8.
"""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(256)
IS_WHITE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow text column; null is the empty text."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word ends at white space or with its row."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_WHITE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] |= solid[cuts]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] |= solid[inner]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """A 64-bit key of each word of lower-cased bytes: a polynomial, made even by mixing.

    Works through pieces of the buffer, so the memory used does not depend on its length.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + piece, side="right")), i + 1)
        out[i:j] = _piece_keys(raw[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def _piece_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        upto = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=upto[1:])
        keys = (upto[ends] - upto[starts]) * _powers(_inverse(_BASE), len(raw))[starts]
        return mixed(keys ^ (ends - starts).astype(np.uint64))


_STEP = 0xD6E8FEB86659FD93


def shingles(keys: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``width`` words and their counts per row.

    A row with fewer words has its whole sequence as the only run; one without words none.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        total = len(keys)
        runs = np.zeros(max(total - width + 1, 0), dtype=np.uint64)
        for j in range(width):
            runs += keys[j : j + len(runs)] * np.uint64(pow(_STEP, j + 1, 1 << 64))
        runs = mixed(runs ^ np.uint64(width))
        whole = np.flatnonzero((count > 0) & (count < width))
        full = np.maximum(count - width + 1, 0)
        out_count = np.where((count > 0) & (count < width), 1, full)
        out_first = np.concatenate([[0], np.cumsum(out_count)])[:-1]
        out = np.zeros(int(out_count.sum()), dtype=np.uint64)
        long = np.flatnonzero(full > 0)
        if len(long):
            take = np.repeat(first[long] - np.concatenate([[0], np.cumsum(full[long])])[:-1], full[long]) + np.arange(int(full[long].sum()))
            put = np.repeat(out_first[long] - np.concatenate([[0], np.cumsum(full[long])])[:-1], full[long]) + np.arange(int(full[long].sum()))
            out[put] = runs[take]
        for r in whole:
            part = keys[first[r] : first[r] + count[r]]
            key = sum((int(k) * pow(_STEP, j + 1, 1 << 64) for j, k in enumerate(part))) & (2**64 - 1)
            out[out_first[r]] = mixed(np.array([key ^ int(count[r])], dtype=np.uint64))[0]
    return out, out_count
