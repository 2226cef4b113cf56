"""Many phrases in many texts at once: an Aho-Corasick automaton over words, as arrays.

The automaton is built level by level with array operations; all texts of a batch advance
together, one word per step, whatever the number of phrases.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 256


class Automaton:
    """Finds, per text, the phrase of the highest rank among those it holds as whole words.

    ``phrases`` are space-joined words; ``ranks`` are distinct numbers from 0.  A state is
    a node of the trie of all phrases; ``edges`` holds state times vocabulary plus word in
    order, ``targets`` the next states, ``fail`` the longest proper suffix that is a state
    too, and ``best`` the highest rank of all phrases that end in a state.
    """

    def __init__(self, phrases: Sequence[str], ranks: Sequence[int]) -> None:
        split = [p.split(" ") for p in phrases]
        self.vocabulary = pa.array(sorted({w for ws in split for w in ws}), pa.string())
        self.n_words = max(len(self.vocabulary), 1)
        self.longest = max((len(ws) for ws in split), default=0)
        flat = pc.index_in(pa.array([w for ws in split for w in ws], pa.string()), self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(ws) for ws in split], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        ranks = np.asarray(ranks, dtype=np.int64)
        at = np.zeros(len(split), dtype=np.int64)  # state of each phrase so far
        self.edges, self.targets = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fail, self.best = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        for depth in range(self.longest):
            alive = np.flatnonzero(sizes > depth)
            key = at[alive] * self.n_words + flat[begin[alive] + depth]
            new, inverse = np.unique(key, return_inverse=True)
            first = len(self.fail)
            at[alive] = first + inverse
            # a new state falls back to where the fallback of its parent goes with its word
            parent, word = new // self.n_words, new % self.n_words
            fall = self.step(self.fail[parent], word) if depth else np.zeros(len(new), np.int64)
            best = np.full(len(new), -1, np.int64)
            ends = alive[sizes[alive] == depth + 1]
            np.maximum.at(best, at[ends] - first, ranks[ends])
            self.fail = np.concatenate([self.fail, fall])
            self.best = np.concatenate([self.best, np.maximum(best, self.best[fall])])
            edges, targets = np.concatenate([self.edges, new]), np.concatenate([self.targets, first + np.arange(len(new))])
            order = np.argsort(edges, kind="stable")
            self.edges, self.targets = edges[order], targets[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; unknown words are -1."""
        out = np.zeros(len(state), dtype=np.int64)
        if not len(self.edges):
            return out
        open_ = np.flatnonzero(word >= 0)
        now = state[open_]
        while len(open_):
            key = now * self.n_words + word[open_]
            k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[k] == key
            out[open_[hit]] = self.targets[k[hit]]
            on = ~hit & (now != 0)
            open_, now = open_[on], self.fail[now[on]]
        return out

    def find(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """The highest rank in each text, -1 if there is none; texts are runs of ``words``.

        Long texts are cut into overlapping parts, so the number of steps does not grow
        with the longest text.
        """
        ids = pc.index_in(words, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        over = max(self.longest - 1, 0)
        parts = np.maximum(-(-(sizes - over) // CHUNK), 1)
        text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(sizes) - sizes)[text] + nth * CHUNK
        length = np.minimum(sizes[text] - nth * CHUNK, CHUNK + over)
        order = np.argsort(-length, kind="stable")  # those that go on are always the first ones
        begin, length, text = begin[order], length[order], text[order]
        state, best = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
        for i in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -i, side="left"))
            state[:n] = self.step(state[:n], ids[begin[:n] + i])
            np.maximum(best[:n], self.best[state[:n]], out=best[:n])
        out = np.full(len(sizes), -1, dtype=np.int64)
        np.maximum.at(out, text, best)
        return out
