"""Chat formatting with offset-aligned loss masks.

Conversations are rendered by a template of control strings, encoded once with character offsets, and the spans of the
assistant's texts are intersected with the token spans, both sorted, by binary search.

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

Control strings inside roles and texts (of this template and of other common ones) get a backslash after their first
character, one more if they have some already, so that unescaping takes exactly one away. The template's own strings
are single tokens that no other token reaches across; a conversation can therefore be rendered and encoded in parts,
cut between turns, and the joined parts are what the whole would give. Rows are range-partitioned by conversation and
turn: a conversation with a third of all rows is spread over many tasks, and no task holds more than one part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from yieldengine.llm.batches import bound_batches

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that may not stand in a text as they are; a backslash goes in after the first character. Fixed values.
CONTROL = (
    START, SEPARATOR, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>",
    "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
)
_TAILS = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
#: Characters of text after which a part ends (with the turn that reaches it), and turns of one part.
PART_CHARS, PART_TURNS = 1 << 18, 256


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The formatted turns, the (role start, role end, text start, text end) of each, and the spans under the loss."""
    parts, spans, loss, at = [], [], [], 0
    for role, text in turns:
        shown, body = escape(role), escape(text)
        first = at + len(START)
        begin = first + len(shown) + len(SEPARATOR)
        spans.append((first, first + len(shown), begin, begin + len(body)))
        if role == learned:
            loss.append((begin, begin + len(body)))
        parts += [START, shown, SEPARATOR, body, END]
        at = begin + len(body) + len(END)
    return "".join(parts), spans, loss


def loss_mask(starts: np.ndarray, ends: np.ndarray, loss: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that overlap a loss span, by binary search of the spans' borders among the sorted token borders."""
    change = np.zeros(len(starts) + 1, dtype=np.int32)
    if loss:
        begin, stop = np.array(loss).T
        some = begin < stop
        first = np.searchsorted(ends, begin[some], side="right")
        last = np.searchsorted(starts, stop[some], side="left")
        np.add.at(change, first, 1)
        np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0


_tokenizers: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        tool = Tokenizer.from_file(path)
        tool.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (START, SEPARATOR, END)])
        _tokenizers[path] = tool
    return _tokenizers[path]


FIELDS = (
    "conv_id long, part long, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, "
    "loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>, "
    "turns array<struct<role_start:int,role_end:int,text_start:int,text_end:int>>"
)
SPAN, TURN = ("start", "end"), ("role_start", "role_end", "text_start", "text_end")


def masked_spans(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(start, end) in characters of every run of tokens under the mask."""
    step = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return np.stack([starts[step[::2]], ends[step[1::2] - 1]], axis=1)


def _lists(parts: list[np.ndarray], names: tuple[str, ...] = ()) -> pa.ListArray:
    """One list per part, of values or (with names) of structs from the columns of the part."""
    borders = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=borders[1:])
    values = np.concatenate(parts)
    if names:
        columns = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(names))]
        return pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays(columns, list(names)))
    return pa.ListArray.from_arrays(borders, pa.array(values))


def _formatted(vocabulary: str, learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tokenizer(vocabulary)
        # range partitions are in order, so partition and place within it order the parts of a conversation
        number = TaskContext.get().partitionId() << 40
        current: int | None = None
        turns: list[tuple[str, str]] = []
        size, pending = 0, []

        def part():
            nonlocal turns, size, number
            text, spans, loss = render(turns, learned)
            pending.append((current, number, text, spans, loss))
            number, turns, size = number + 1, [], 0

        def flush():
            ids, starts, ends, masks, spans = [], [], [], [], []
            for _, _, text, _, loss in pending:
                encoding = tool.encode(text, add_special_tokens=False)
                ids.append(np.array(encoding.ids, dtype=np.int32))
                offsets = np.fromiter(chain.from_iterable(encoding.offsets), dtype=np.int32).reshape(-1, 2)
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(loss_mask(starts[-1], ends[-1], loss))
                spans.append(masked_spans(starts[-1], ends[-1], masks[-1]))
            done = [
                pa.array([p[0] for p in pending], pa.int64()), pa.array([p[1] for p in pending], pa.int64()),
                pa.array([p[2] for p in pending], pa.string()), _lists(ids), _lists(starts), _lists(ends), _lists(masks),
                _lists(spans, SPAN), _lists([np.array(p[3], dtype=np.int32) for p in pending], TURN),
            ]
            pending.clear()
            return pa.RecordBatch.from_arrays(done, names=[
                "conv_id", "part", "formatted", "input_ids", "token_starts", "token_ends", "loss_mask", "loss_spans", "turns"])

        for batch in batches:
            for conversation, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and conversation != current:
                    part()
                current = conversation
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
                if size >= PART_CHARS or len(turns) >= PART_TURNS:
                    part()
                if len(pending) >= 256 or sum(len(p[2]) for p in pending[-8:]) >= 4 * PART_CHARS:
                    yield flush()
        if turns:
            part()
        if pending:
            yield flush()

    return run


def format_conversations(conversations: DataFrame, vocabulary: str, learned: str = "assistant") -> DataFrame:
    """One row per part of a conversation (most have one), `part` in order: the formatted text, its token ids with
    their character spans, the loss mask (tokens of the texts of role `learned`), the character spans of the runs of tokens
    under it, and the spans of roles and texts.

    Turns go by turn (null first), then role, then text, so ties and repeated rows have a fixed order and all stay. Null
    roles and texts are empty; a null conv_id is one conversation. An empty assistant text has no token under the loss.
    Further columns are ignored, a table without rows gives none.
    """
    bound_batches(conversations.sparkSession)
    given = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    # rows that agree in all but the text are told apart by its hash, so that no key grows without bound
    ordered = (
        given.withColumn("tie", F.xxhash64("text")).repartitionByRange("conv_id", "turn", "role", "tie")
        .sortWithinPartitions("conv_id", "turn", "role", "tie", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted(vocabulary, learned), FIELDS)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by (conv_id, part): a running digest of each conversation, a part at a time."""
    begun, current, state, done = False, None, None, []

    def fresh():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def result():
        rows = list(zip(*done)) or [()] * 6
        done.clear()
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def close():
        done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != current:
                if begun:
                    close()
                begun, current, state = True, row["conv_id"], fresh()
            text = row["formatted"]
            for block in text.split(END)[:-1]:
                role, body = block.removeprefix(START).split(SEPARATOR)
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            # the runs of tokens under the loss; a control token ends a run
            for span in row["loss_spans"]:
                learned = unescape(text[span["start"] : span["end"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
        yield result()
    if begun:
        close()
        yield result()


def digest_conversations(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its parts: number of turns, digest of the unescaped roles and texts, characters
    and digest of the unescaped text under the loss mask, characters of the formatted text.

    A digest of one conversation is sequential; it streams through its parts in constant memory.
    """
    return (
        parts.select("conv_id", "part", "formatted", "loss_spans")
        .repartition("conv_id").sortWithinPartitions("conv_id", "part")
        .mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                               "formatted_chars long")
    )
