"""Token-id output: texts become byte-level BPE ids, packed into rows of fixed length by best-fit decreasing.

Texts longer than a row are split without loss into full rows and a rest. Pieces are placed longest first, each into the
open row with the least room that still takes it; a segment tree over room sizes finds it in logarithmic time. A packed row
carries its ids (padded), the cumulative lengths of its segments, and positions that begin anew in every segment.

A task packs its own documents in pools of at most POOL tokens: no shuffle, memory bounded by the pool, and what a
pool wastes is one partly filled row or so among thousands.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.textscan import PIECE, SPACE, utf8
from yieldengine.llm.units import UnitEncoder

LENGTH = 2048
PADDING = 50256
POOL = 4_000_000
#: The pattern of this vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the unit rule below does not know; texts that hold some are encoded as they are.
_RARE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class ByteEncoder(UnitEncoder):
    """Byte-level BPE by a vocabulary of ranks; a text of over a megabyte is encoded in pieces that no token crosses."""

    def __init__(self, rank_file: str):
        super().__init__()
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fresh(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        # units: white space before a word leaves its last character out: a space goes with the word, another one stands alone
        gap, space = SPACE[block], block == 0x20
        ends, begins = np.zeros(len(block), dtype=bool), np.zeros(len(block), dtype=bool)
        ends[bounds[1:][bounds[1:] > 0] - 1] = True
        begins[bounds[:-1][bounds[:-1] < len(block)]] = True
        word_next = np.append(~gap[1:], False) & ~ends
        gap_before = np.append(False, gap[:-1]) & ~begins
        space_before = np.append(False, space[:-1]) & ~begins
        return begins | (gap & word_next) | (gap & ~gap_before) | (~gap & gap_before & ~space_before)

    def encode_rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The token ids of every row, in order; null is empty."""
        column = pc.fill_null(column, "")
        rare = pc.match_substring_regex(column, _RARE_SPACE).to_numpy(zero_copy_only=False)
        data, offsets = utf8(column)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            ids: list[int] = []
            while a < b:
                block = data[a:b] if rare[i] or b - a <= PIECE else self._piece(data, a, b)[0]
                ids += self.encoding.encode_ordinary(block.tobytes().decode())
                a += len(block)
            yield np.array(ids, dtype=np.uint16)


_encoders: dict[str, ByteEncoder] = {}


def _encoder(rank_file: str) -> ByteEncoder:
    if rank_file not in _encoders:
        _encoders[rank_file] = ByteEncoder(rank_file)
    return _encoders[rank_file]


class RoomTree:
    """Segment tree over room sizes 0..length: which of them some open row has."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, need: int) -> int:
        """The smallest room of at least `need`, or -1."""
        node, count = need + self.size, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of numbers of pieces; every piece is in one row, no row holds more than `length`."""
    tree = RoomTree(length)
    rows: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least(sizes[piece])
        if room < 0:
            row, room = len(rows), length
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        left = room - sizes[piece]
        by_room.setdefault(left, []).append(row)
        tree.add(left, 1)
    return rows


FIELDS = (
    "pack_id long, doc_ids array<long>, first_tokens array<long>, cumulative_lengths array<int>, n_tokens int, "
    "input_ids binary, positions binary"
)


def _packed(rank_file: str, length: int, padding: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(rank_file)
        number = TaskContext.get().partitionId() << 32
        pool: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush():
            nonlocal held, number
            rows = best_fit_decreasing([len(ids) for _, _, ids in pool], length)
            for x in range(0, len(rows), 256):
                columns = [[] for _ in range(7)]
                for row in rows[x : x + 256]:
                    parts = [pool[i] for i in row]
                    ends = np.cumsum([0, *(len(ids) for _, _, ids in parts)])
                    matrix, places = np.full(length, padding, dtype="<u2"), np.zeros(length, dtype="<u2")
                    for (_, _, ids), a, b in zip(parts, ends[:-1].tolist(), ends[1:].tolist()):
                        matrix[a:b] = ids
                        places[a:b] = np.arange(b - a)
                    values = (number, [p[0] for p in parts], [p[1] for p in parts], ends.tolist(), int(ends[-1]),
                              matrix.tobytes(), places.tobytes())
                    for column, value in zip(columns, values):
                        column.append(value)
                    number += 1
                longs = pa.list_(pa.int64())
                types = (pa.int64(), longs, longs, pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[
                    "pack_id", "doc_ids", "first_tokens", "cumulative_lengths", "n_tokens", "input_ids", "positions"])
            pool.clear()
            held = 0

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), tool.encode_rows(batch.column(1))):
                for a in range(0, len(ids), length):
                    pool.append((key, a, ids[a : a + length]))
                held += len(ids)
                if held >= POOL:
                    yield from flush()
        if pool:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, rank_file: str, length: int = LENGTH, padding: int = PADDING) -> DataFrame:
    """Packed rows: pack_id, doc_ids and first_tokens (document and offset in it of each segment), cumulative_lengths
    (from 0), n_tokens, input_ids and positions (little-endian 16-bit matrices of `length` columns).

    Every token of every text is in exactly one row. Null and empty texts have no tokens and are in no row; repeated
    rows are packed as often as they occur, a null doc_id stays null, other columns are ignored, a table without rows
    gives none. Lengths are below 65,536, as are ids.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return given.mapInArrow(_packed(rank_file, length, padding), FIELDS)
