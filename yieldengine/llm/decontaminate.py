"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

A seed is the shortest run of at least three words of an item that chance would repeat less than once in 10^9
positions, by the word frequencies of the whole corpus (not by how often the run occurs: a leaked passage may occur in
a third of all documents). Where a document holds a seed, the words around it are aligned with the item word by word
(match +2, mismatch -1, gap -1, local); the share of the item's full score tells exact, edited and paraphrased copies
from chance. A long passage of a longer item is a copy too, by the share of the passage's own full score.

Items are taken in blocks of a fixed number of words, so what a task holds of the benchmark has a bound; a larger
benchmark costs further passes. Nothing is shuffled but word counts, and rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.textscan import PUNCTUATED, document_words, gram_hashes, integers

MATCH, MISMATCH, GAP = 2, -1, -1
#: A hit has this share of the full score of the item, or, from EXCERPT_WORDS words on, of the passage that is aligned.
LEAST_SHARE = 0.5
EXCERPT_WORDS = 20
LEAST_WORDS, MOST_WORDS = 3, 16
CHANCE = 1e-9
#: An item without a seed is searched by its longest runs if chance repeats them in less than this share of positions.
COMMON = 1e-6
#: Words of the benchmark held by a task at a time.
BLOCK_WORDS = 1_000_000


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    return list(document_words(pa.array(texts, pa.string()), gap=PUNCTUATED))


def _count(known):
    """Per batch: how often each word of the items occurs, and under a null word the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(known.value, dtype=np.uint64)
        maybe = _filter(words)
        counts, total = np.zeros(len(words), dtype=np.int64), 0
        for batch in batches:
            for row in document_words(batch.column(0), gap=PUNCTUATED):
                total += len(row)
                at = np.searchsorted(words, row := row[maybe[row & _LOW]])
                at = at[words[np.minimum(at, len(words) - 1)] == row]
                counts += np.bincount(at, minlength=len(words))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([None, *words[seen].view(np.int64).tolist()], pa.int64()),
            pa.array([total, *counts[seen].tolist()], pa.int64()),
        ], names=["word", "n"])

    return run


_LOW = np.uint64((1 << 20) - 1)


def _filter(values: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[values & _LOW] = True
    return maybe


def _seeds(items: list[np.ndarray], chance: dict[int, float]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By run length: fingerprints (sorted), item numbers and positions of the seeds."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for number, words in enumerate(items):
        logs = np.log([chance[int(w)] for w in words]) if len(words) else np.zeros(0)
        ahead = np.concatenate([[0], np.cumsum(logs)])
        lengths: dict[int, list[int]] = {}
        for start in range(len(words)):
            for n in range(LEAST_WORDS, min(MOST_WORDS, len(words) - start) + 1):
                if ahead[start + n] - ahead[start] <= np.log(CHANCE):
                    lengths.setdefault(n, []).append(start)
                    break
        n = min(MOST_WORDS, len(words))
        if not lengths and n >= LEAST_WORDS:  # nothing rare in it: the longest runs it has
            lengths[n] = [x for x in range(len(words) - n + 1) if ahead[x + n] - ahead[x] <= np.log(COMMON)]
        for n, starts in lengths.items():
            grams = gram_hashes(words, n)
            found.setdefault(n, []).extend((int(grams[x]), number, x) for x in starts)
    out = {}
    for n, rows in found.items():
        rows.sort()
        out[n] = (
            np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        )
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of an item with a window: score, and first and one past the last word of the window in it."""
    width = len(window)
    place = np.arange(width + 1)
    score, start = np.zeros(width + 1, dtype=np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        step = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        cell = np.concatenate([[0], np.maximum(step, up)])
        origin = np.concatenate([[0], np.where(step >= up, start[:-1], start[1:])])
        origin = np.where(cell > 0, origin, place)
        cell = np.maximum(cell, 0)
        # a gap in the item: carry the best cell to the left, less its distance
        lifted = cell - GAP * place
        source = np.maximum.accumulate(np.where(lifted >= np.maximum.accumulate(lifted), place, 0))
        score, start = lifted[source] + GAP * place, origin[source]
        start = np.where(score > 0, start, place)
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, times, items, seeds = block.value
        maybe = {n: _filter(grams) for n, (grams, _, _) in seeds.items()}
        for batch in batches:
            rows = []
            for key, words in zip(integers(batch.column(0)), document_words(batch.column(1), gap=PUNCTUATED)):
                begins: dict[int, list[int]] = {}
                for n, (grams, of, at) in seeds.items():
                    hashes = gram_hashes(words, n)
                    hit = np.flatnonzero(maybe[n][hashes & _LOW])
                    if len(hit):
                        low, high = (np.searchsorted(grams, hashes[hit], side=x) for x in ("left", "right"))
                        for x, a, b in zip(hit.tolist(), low.tolist(), high.tolist()):
                            for k in range(a, b):
                                begins.setdefault(int(of[k]), []).append(x - int(at[k]))
                for number, diagonals in begins.items():
                    item = items[number]
                    margin = len(item) // 2 + 4
                    best, stop = (0, 0, 0), -1
                    spans: list[list[int]] = []
                    for d in sorted(set(diagonals)):
                        a, stop = max(0, d - margin), min(len(words), d + len(item) + margin)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = stop
                        else:
                            spans.append([a, stop])
                    for a, b in spans:
                        score, x, y = align(item, words[a:b])
                        if score > best[0]:
                            best = (score, a + x, a + y)
                    share = best[0] / (MATCH * len(item))
                    own = best[2] - best[1]
                    if share >= LEAST_SHARE or own >= EXCERPT_WORDS and best[0] >= LEAST_SHARE * MATCH * own:
                        rows.extend([(key, numbers[number], best[0], share, best[1], best[2])] * times[number])
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "item_id", "score", "share", "first_word", "end_word"],
            )

    return run


FIELDS = "doc_id long, item_id long, score long, share double, first_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row and item of which it holds a copy, whole or a long passage: doc_id, item_id, score, share (of the full score),
    first_word and end_word (words of the document without ASCII punctuation, from 0).

    Null and empty texts match nothing, nor do items of fewer than LEAST_WORDS words or of common words alone (COMMON):
    a text that holds "yes" is no copy of an item "yes". Very long texts are read whole; of alignments of equal score the
    first is reported. Repeated document rows give repeated results,
    repeated items one result each; a null doc_id or item_id stays null. Further columns are ignored. Without documents
    or items the result is empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # a repeated item is searched once, and its results are repeated
    tests = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count(F.lit(1)).alias("times"))
    size = tests.agg(F.sum(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 2))).first()[0] or 0  # words, at most
    blocks = -(-size // BLOCK_WORDS) or 1
    out = []
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = _item_words([r["text"] for r in rows])
        words = np.unique(np.concatenate(items)) if items else np.zeros(0, dtype=np.uint64)
        if not len(words):
            continue
        counts = dict(
            given.select("text").mapInArrow(_count(spark.sparkContext.broadcast(words.tobytes())), "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect()
        )
        total = max(counts.pop(None, 0), 1)
        chance = {int(w): max(counts.get(int(w.view(np.int64)), 0), 1) / total for w in words}
        value = ([r["item_id"] for r in rows], [r["times"] for r in rows], items, _seeds(items, chance))
        out.append(given.mapInArrow(_search(spark.sparkContext.broadcast(value)), FIELDS))
    if not out:
        return spark.createDataFrame([], FIELDS)
    leaks = out[0]
    for more in out[1:]:
        leaks = leaks.unionByName(more)
    return leaks
