"""Distinct chunks of text, each tokenized once in a task and joined back to its places by index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import common

#: Distinct chunks that a task keeps; beyond it the table starts anew, which costs time but changes no result.
MOST = 800_000


class ChunkTable:
    """The ids of distinct chunks. encode gets a list of chunks (bytes) and returns all their ids, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], end: int, most: int = MOST):
        self.encode, self.end, self.most = encode, end, most
        self._clear()

    def _clear(self) -> None:
        """Leaves one entry, the first, which is no chunk: the end id."""
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.full(1 << 16, self.end, np.int32), 1
        self.counts, self.starts = np.ones(1, np.int32), np.zeros(1, np.int32)

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """Where each of the chunks (all of one slice) stands in the table."""
        new = [x for x in chunks if x not in self.index]
        if len(self.index) + len(new) > self.most:
            self._clear()
            new = chunks
        if new:
            new = list(dict.fromkeys(new))
            ids, counts = self.encode(new)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, len(ids)), np.int32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.index.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, (self.used + np.cumsum(counts) - counts).astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.used += len(ids)
        return np.fromiter(map(self.index.__getitem__, chunks), np.int32, len(chunks))

    def gathered(self, place: np.ndarray) -> np.ndarray:
        """The ids of the chunks at these places of the table, after each other."""
        counts = self.counts[place]
        return self.flat[common.ranges(self.starts[place].astype(np.int64), counts.astype(np.int64))]

    def tokens(self, data: np.ndarray, starts: np.ndarray, first: np.ndarray, lead: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are cut at starts into chunks, an end id after each text, and the index of each text's first id.

        first: each text's first chunk. lead: bytes that stand before a text's first chunk.
        """
        ends = np.append(starts[1:], len(data))
        words = common.binary_array(data, starts, ends).dictionary_encode()
        heads = np.unique(first[:-1][np.diff(first) > 0]) if lead else []
        place = self.places(words.dictionary.to_pylist() + [lead + data[starts[k] : ends[k]].tobytes() for k in heads])
        place_of = place[words.indices.to_numpy()] if len(starts) else np.zeros(0, np.int32)
        place_of[heads] = place[len(words.dictionary) :]
        place_of = np.insert(place_of, first[1:], 0)
        counts = self.counts[place_of]
        before = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=before[1:])
        at = np.repeat(self.starts[place_of] - before[:-1], counts)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], before[first + np.arange(len(first))].astype(np.int64)


def text_array(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string()).cast(pa.string())
