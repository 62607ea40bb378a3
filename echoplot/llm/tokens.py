"""Whole-text encoding with a byte-level BPE tokenizer file.

A single space between two other characters always begins a token of the byte-level
pattern, so texts are cut there (at the byte level, in numpy), each distinct piece is
encoded once by the tokenizer, and the ids are put together again. The ids equal those of
encoding the whole text. Where the neighbours of a space might be white space outside
ASCII, no cut is made.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from .common import SPACE, U, RollingHash

#: lead bytes of characters that may be white space
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
CACHE = 1_000_000


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker process: it and its pieces serve the tasks to come."""
    return Encoder(path)


class Encoder:
    """Encodes chunks of texts; keeps what it has encoded, up to CACHE pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text cannot write special tokens
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)  # byte-level vocabularies have a character for a byte
        self.clear()

    def clear(self):
        self.key, self.slot = np.zeros(0, U), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, key: np.ndarray, pieces: list[str], size: np.ndarray) -> None:
        # without offsets; tokens tile the pieces' bytes, so their lengths tell the pieces apart
        e = self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(e.ids, np.int32)
        upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(size), "right")
        count = np.diff(upto, prepend=0)
        n = len(self.start) - 1
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(count)])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.key, key)  # both sorted
        self.key, self.slot = np.insert(self.key, at, key), np.insert(self.slot, at, n + np.arange(len(pieces)))

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and n + 1 offsets into them."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        at = np.flatnonzero(raw == 32)
        at = at[(at > 0) & (at < n - 1)]
        wide = WIDE[raw]
        near = SPACE[raw[at - 1]] | SPACE[raw[at + 1]] | wide[at + 1]
        for back in (2, 3):
            near |= (at >= back) & wide[at - back]
        begins = np.zeros(n, bool)
        begins[at[~near]] = True
        begins[off[:-1][np.diff(off) > 0]] = True
        cut = np.flatnonzero(begins)
        stop = np.append(cut[1:], n)
        with np.errstate(over="ignore"):
            key = RollingHash(raw).spans(cut, stop)
        kind, first, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) > CACHE:
            self.clear()
        spot = np.minimum(np.searchsorted(self.key, kind), max(0, len(self.key) - 1))
        new = self.key[spot] != kind if len(self.key) else np.ones(len(kind), bool)
        if new.any():
            whole = raw.tobytes()
            self._learn(kind[new], [whole[a:b].decode("utf-8", "replace") for a, b in zip(cut[first[new]], stop[first[new]], strict=True)], (stop - cut)[first[new]])
            spot = np.searchsorted(self.key, kind)
        slot = self.slot[spot][which]
        count = self.start[slot + 1] - self.start[slot]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.start[slot] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(cut, off, "left")]
