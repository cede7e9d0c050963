"""Encoding with a merge-type SentencePiece vocabulary by backtracking, and decoding.

The encoding that merging pairs by rank would give is the only one in which every two adjacent tokens are compatible:
merging their joint characters again gives these two tokens. So it is found from left to right. An Aho-Corasick
automaton (over reversed pieces and text) tells the longest piece at every position; a piece is taken if it is
compatible with the last one, else the next shorter prefix is tried, else the last piece is given back. A bitfield
marks positions from which the text cannot be finished, so none is tried twice.

Runs of spaces have pieces of equal rank, for which merging goes leftmost first; they are encoded by that rule.
Characters outside the vocabulary become byte pieces; no merge crosses them, a space after a word, or a line feed.
So a text is a sequence of short units, and units that repeat within a block or in the worker's cache are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.textscan import utf8
from yieldengine.llm.units import UnitEncoder

MARK = "▁"
#: Adjacent pairs whose compatibility a worker remembers.
PAIRS = 1_000_000


class PieceEncoder(UnitEncoder):
    """Encoder and decoder for one model file; one per worker process."""

    def __init__(self, model_file: str):
        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.ids = {piece: i for i, piece in enumerate(self.text) if not special[i]}
        self.rank = {i: model.get_score(i) for i in self.ids.values()}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.single = {piece for piece in self.ids if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if MARK * 2 not in piece:
                self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        self.length = [len(piece) for piece in self.text]
        self.prefix: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.run_limit = max((len(p) for p in self.ids if p == MARK * len(p)), default=1)

    def _merged(self, text: str) -> list[int]:
        """The encoding of a short text by merging: best rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = self.ids.get(parts[i] + parts[i + 1])
                if joined is not None and (best is None or self.rank[joined] > best):
                    best, at = self.rank[joined], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[part] for part in parts]

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._merged(self.text[left] + self.text[right]) == [left, right]
        return known

    def _shorter(self, piece: int) -> int:
        """The longest piece that is a proper prefix of `piece`, or -1."""
        known = self.prefix.get(piece)
        if known is None:
            text = self.text[piece]
            known = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.prefix[piece] = known
        return known

    def _backtrack(self, text: str) -> list[int]:
        """The encoding of a text of known characters."""
        n = len(text)
        longest = [-1] * n
        for end, piece in self.automaton.iter(text[::-1]):
            if longest[~end] < 0:  # the automaton tells the longest one first
                longest[~end] = piece
        dead, at, out, last, length, fits = 0, 0, [], -1, self.length, self.fits
        piece = longest[0]
        while at < n:
            while piece >= 0:
                end = at + length[piece]
                if not dead >> end & 1:
                    good = last < 0 or fits.get(last << 20 | piece)
                    if good or (good is None and self._compatible(last, piece)):
                        out.append(piece)
                        at, last = end, piece
                        piece = longest[at] if at < n else -1
                        break
                piece = self._shorter(piece)
            else:
                dead |= 1 << at
                piece = out.pop()
                last = out[-1] if out else -1
                at -= length[piece]
        return out

    def _known_runs(self, text: str) -> list[int]:
        """The encoding of a text without space runs, split where a character is outside the vocabulary."""
        if self.single.issuperset(text):
            return self._backtrack(text) if text else []
        out: list[int] = []
        start = 0
        for i, char in enumerate(text):
            if char not in self.single:
                if i > start:
                    out += self._backtrack(text[start:i])
                out += [self.byte[b] for b in char.encode()]
                start = i + 1
        if start < len(text):
            out += self._backtrack(text[start:])
        return out

    @lru_cache(maxsize=256)  # noqa: B019 (one encoder lives as long as its worker)
    def _short_run(self, n: int) -> tuple[int, ...]:
        return tuple(self._merged(MARK * n))

    def _space_run(self, n: int) -> list[int]:
        """n spaces: leftmost first fills pieces of the longest kind, then the rest."""
        full, rest = divmod(n, self.run_limit)
        return [self.ids[MARK * self.run_limit]] * full + (list(self._short_run(rest)) if rest else [])

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """A run of spaces (given as such) followed by characters other than spaces."""
        body = unit.lstrip(" ")
        spaces = len(unit) - len(body)
        out = self._known_runs((MARK if spaces else "") + body)
        if spaces > 1:
            if out[0] == self.ids[MARK]:  # the last space was not merged into the word
                out = self._space_run(spaces) + out[1:]
            else:
                out = self._space_run(spaces - 1) + out
        return tuple(out)

    def encode_unit_bytes(self, unit: bytes) -> tuple[int, ...]:
        return self.encode_unit(unit.decode())

    def fresh(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        space, line = block == 0x20, block == 0x0A
        fresh = line.copy()
        fresh[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        return fresh

    def encode_rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The token ids of every row, in order; null is empty."""
        column = pc.fill_null(column, "")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # the model writes spaces so, and reads both alike
        return self.encode_spans(*utf8(pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))))


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


#: Rows of one output batch.
ROWS = 512


def _round_trip(model_file: str, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model_file)
        for batch in batches:
            for x in range(0, batch.num_rows, ROWS):
                part = batch.slice(x, ROWS)
                rows = list(tool.encode_rows(part.column(carried)))
                ends = np.cumsum([0, *map(len, rows)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
                decoded = pa.array([tool.model.decode(ids.tolist()) for ids in rows], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:carried], ids, decoded], names=[*part.schema.names[:carried], "piece_ids", "decoded"]
                )

    return run


def encode_pieces(docs: DataFrame, model_file: str, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, with piece_ids (array<int>) of its whole text and decoded (string).

    A null or empty text has no ids and decodes to the empty text. Rows are independent: repeated rows give repeated
    results, nulls in kept columns stay, other columns are ignored, a table without rows gives none.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(*[F.col(c) for c in keep], F.col(text_column).alias("__text"))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(_round_trip(model_file, len(keep)), f"{fields}piece_ids array<int>, decoded string")
