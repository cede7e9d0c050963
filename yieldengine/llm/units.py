"""Encoding of whole texts by units that no token crosses: each distinct unit of a block is encoded once.

A block is a number of whole rows, or a piece of a longer one, of about a megabyte. Its units are told apart by
fingerprint, looked up by their bytes in a cache of the worker, and the block's token ids are gathered from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

from yieldengine.llm.textscan import PIECE, span_hashes

#: Units that a worker remembers, in each of two generations, and the bytes of the longest one.
REMEMBERED, LONGEST = 200_000, 200


class UnitEncoder:
    """Base of encoders: `fresh` tells where units begin, `encode_unit_bytes` encodes one."""

    def __init__(self):
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def encode_unit_bytes(self, unit: bytes) -> tuple[int, ...]:
        raise NotImplementedError

    def fresh(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marks of the bytes at which a unit begins; `bounds` are the row borders in the block, its ends included."""
        raise NotImplementedError

    def _units(self, block: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block and the number of tokens of each unit; `fresh` marks bytes that begin a unit."""
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(block))
        _, first, which = np.unique(span_hashes(block, starts, ends), return_index=True, return_inverse=True)
        raw = block.tobytes()
        found: list[tuple[int, ...]] = []
        young, old = self.young, self.old
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            unit = raw[a:b]
            ids = young.get(unit)
            if ids is None:
                ids = old.get(unit)
                if ids is None:
                    ids = self.encode_unit_bytes(unit)
                if len(unit) < LONGEST:
                    young[unit] = ids
            found.append(ids)
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ahead = np.cumsum(counts) - counts
        return flat[np.repeat(begin[which] - ahead, counts) + np.arange(int(counts.sum()))], counts

    def encode_spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The token ids of the rows data[offsets[i]:offsets[i + 1]], in order."""
        row = 0
        while row < len(offsets) - 1:
            first, last = row, row + 1
            while last < len(offsets) - 1 and offsets[last + 1] - offsets[first] <= PIECE:
                last += 1
            row = last
            a, b = int(offsets[first]), int(offsets[last])
            if last == first + 1 and b - a > PIECE:
                parts = []
                while a < b:
                    block, fresh = self._piece(data, a, b)
                    parts.append(self._units(block, fresh)[0])
                    a += len(block)
                yield np.concatenate(parts)
                continue
            block, bounds = data[a:b], offsets[first : last + 1] - a
            if not len(block):
                yield from (np.zeros(0, dtype=np.int32) for _ in range(last - first))
                continue
            fresh = self.fresh(block, bounds)
            fresh[bounds[:-1][bounds[:-1] < len(block)]] = True
            ids, counts = self._units(block, fresh)
            ahead = np.concatenate([[0], np.cumsum(counts)])
            cut = ahead[np.searchsorted(np.flatnonzero(fresh), bounds)]
            for i in range(last - first):
                yield ids[cut[i] : cut[i + 1]]

    def _piece(self, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The next bytes of a long row that end where a unit ends, about PIECE or, at need, more."""
        size = PIECE
        while True:
            block = data[a : min(a + size, b)]
            fresh = self.fresh(block, np.array([0, len(block)]))
            fresh[0] = True
            if a + len(block) == b:
                return block, fresh
            last = int(np.flatnonzero(fresh[: len(block) - 1])[-1])  # what the last byte begins may hang on the next one
            if last > 0:
                return block[:last], fresh[:last]
            size *= 2
