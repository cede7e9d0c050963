"""Spelling variants: dense prefix-suffix tiling over padded code-point matrices.

Two words are near when one edit (insertion, deletion, replacement of a code point) turns one into the other. With m the
longer length that is so exactly when their common prefix and common suffix together reach m - 1. One of the two is then
at least half of that, so words meet in blocks that share their first, or their last, ceil((m - 1) / 2) code points; a
block is cut into tiles of at most TILE words, and tiles are compared pair by pair as matrices of code points: for all
cells at once the first column that differs (prefix) and the last one (suffix, of right-aligned rows).

A tile yields per word only a count and its best neighbour, so what is shuffled after the comparison follows the
words, not their pairs. No block is gathered: its tiles are pairs of bounded parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.staging import stage

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
DELETE_ONE_IN = 97
#: Words of one side of a tile, cells of a comparison held at a time, distinct words counted together in a task.
TILE, CELLS, HELD = 1024, 1 << 20, 100_000
#: Longer words are counted by themselves, so that the words held in a task are bounded in bytes too.
LONG = 1 << 12

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _edited(doc_id: str, run: str) -> str:
    """The run, without one code point where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DELETE_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts with their numbers, of a window of texts each."""
    total: Counter[str] = Counter()

    def emit(words: dict[str, int]):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = Counter(m[0].translate(_LOWER) for m in _RUN.finditer(text.as_py() or ""))
            for run, n in runs.items():
                word = _edited("" if doc is None else doc, run)
                if len(word) >= LONG:
                    yield emit({word: n})
                elif len(word) >= LEAST_LENGTH:
                    total[word] += n
            if len(total) >= HELD:
                yield emit(total)
                total = Counter()
    if total:
        yield emit(total)


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more in all texts."""
    given = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    counted = given.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, one row a word, padded on the right (or on the left) with zero."""
    align = str.rjust if right else str.ljust
    joined = "".join(align(w, width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows, how many first columns agree."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(axis=2)
    first[~differ.any(axis=2)] = a.shape[1]
    return first


def _near(one: list[str], two: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of single edits between words of lengths m - 1 and m, at least one of m, and their common prefix."""
    out: list[tuple] = []
    left, right = (_matrix(w, m, False) for w in (one, two))
    left_end, right_end = (_matrix(w, m, True)[:, ::-1] for w in (one, two))
    long_left, long_right = (np.array([len(x) == m for x in w]) for w in (one, two))
    wide = min(len(two), max(1, CELLS // m))  # a word of the other side may be as long as the cells held
    rows = max(1, CELLS // (m * wide))
    for y in range(0, len(two), wide):
        t = slice(y, y + wide)
        for x in range(0, len(one), rows):
            s = slice(x, x + rows)
            prefix, suffix = _agreeing(left[s], right[t]), _agreeing(left_end[s], right_end[t])
            near = (prefix + suffix >= m - 1) & (prefix < m) & (long_left[s, None] | long_right[None, t])
            i, j = np.nonzero(near)
            out.append((i + x, j + y, prefix[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by tile: per word of a tile its number of near words there and the best of them."""
    names = ("end", "m", "part", "i", "j", "block", "word", "n")
    held: list[tuple] = []
    out: dict[str, list] = {}

    def compare(rows: list[tuple]) -> None:
        _, m, _, i, j, *_ = rows[0]
        one = [(r[6], r[7]) for r in rows if r[5] == i]
        two = one if i == j else [(r[6], r[7]) for r in rows if r[5] == j]
        if not one or not two:
            return
        left, right, prefix = _near([w for w, _ in one], [w for w, _ in two], m)
        new = (prefix >= -(-(m - 1) // 2)) == (rows[0][0] == 0)  # pairs that share the first half are found by that one
        if i == j:
            new &= left < right
        for a, b in zip(left[new].tolist(), right[new].tolist()):
            for (word, _), (other, n) in ((one[a], two[b]), (two[b], one[a])):
                best = out.setdefault(word, [0, -n, other])
                best[0] += 1
                if (-n, other) < (best[1], best[2]):
                    best[1:] = [-n, other]

    def emit():
        rows = list(out.items())
        out.clear()
        return pa.RecordBatch.from_arrays([
            pa.array([w for w, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()),
            pa.array([-v[1] for _, v in rows], pa.int64()), pa.array([v[2] for _, v in rows], pa.string()),
        ], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names)):
            if held and row[:5] != held[0][:5]:
                compare(held)
                held = []
                if len(out) >= HELD:
                    yield emit()
            held.append(row)
    if held:
        compare(held)
    if out:
        yield emit()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: per word with a near one, their number and the most frequent of them (ties: the smallest).

    `words` has distinct words with their n.
    """
    length = F.char_length("word")
    # a word stands in blocks as one of the longer length m and, one shorter, as the other side of those of m
    meets = F.explode(F.array(*[
        F.struct(F.lit(end).alias("end"), (length + more).cast("int").alias("m")) for end in (0, 1) for more in (0, 1)
    ]))
    placed = words.select("word", "n", meets.alias("at")).select("word", "n", "at.*")
    half = F.ceil((F.col("m") - 1) / 2).cast("int")
    part = F.when(F.col("end") == 0, F.substring("word", F.lit(1), half)).otherwise(F.expr("right(word, cast(ceil((m - 1) / 2) as int))"))
    # blocks are told apart by a hash: a chance meeting of two is compared like any other and found not near, or dropped here
    placed = placed.withColumn("part", F.xxhash64(part))
    sizes = (
        placed.groupBy("end", "m", "part").agg(F.count("*").alias("size"), F.max(F.char_length("word")).alias("longest"))
        .where("size > 1 and longest = m").select("end", "m", "part", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    )
    dealt = (
        placed.join(sizes, ["end", "m", "part"])
        .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("end", "m", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")
    )
    tile = ["end", "m", "part", "i", "j"]
    found = dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tiles, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def _roots(words: DataFrame) -> DataFrame:
    """word, root for words with a form: forms are followed by doubling, each step a join of the table with itself.

    A form is at least TIMES as frequent as its word, so paths are short and without rings. A form is near to all words
    that point at it, so their number is bounded by the length of the word and not by the table.
    """
    steps = stage(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "spelling-roots")
        if not moved.where("further is not null").head(1):
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every word of the texts with the form and the root it is a variant of: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters, A-Z lower-cased, with one code point deleted where the checksum of document
    and run asks for it. Null and empty texts hold none; a null id counts as an empty one; repeated rows count as often
    as they stand there; ties between near words go to the smallest. Texts are read whole, words of any length take
    part. Further columns are ignored, whatever their names; a table without rows gives none.
    """
    bound_batches(docs.sparkSession)
    words = stage(count_words(docs, id_column, text_column), "spelling-words")
    near = near_words(words)
    placed = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("form_n") >= TIMES * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")],
    ), "spelling-near")
    return placed.join(_roots(placed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
