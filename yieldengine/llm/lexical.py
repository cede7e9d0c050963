"""Ranked lexical search: best-first document intervals bounded by range-maximum sparse tables of the posting lists.

The texts are read once: tasks write blocks of documents with the posting lists of the query terms alone, from which the
corpus counts follow. A block then answers every item by itself. Each list has its impacts and a sparse table of the
places of their maxima. An interval of documents is bounded by the sum, over the item's terms, of the largest impact in
that interval; the intervals of highest bound are split at the document that holds their largest single contribution,
whose score is made in full, and an interval is dropped when its bound is below the scores already sure: those of the
ten best of the block, and of a first short search of all blocks (probe), whose tenth best real score of an item holds
for every block.

Many intervals are split at a time; the arithmetic is on 64-bit integers throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.textscan import document_words, integers
from yieldengine.staging import stage

#: Fixed values of the score.
WEIGHT, IMPACT, SATURATION, LENGTH_PART = 1000, 1_000_000_000, 8, 75
#: Documents and postings of one block, and distinct query terms searched in one pass over the texts.
BLOCK_DOCS, BLOCK_POSTINGS, PASS_TERMS = 1 << 14, 1 << 20, 1 << 20
#: Intervals split at a time, and such steps of the probe.
SPLITS, PROBE_STEPS = 64, 2

#: Separators of terms: all of ASCII but letters and digits.
GAP = np.zeros(256, dtype=bool)
GAP[:128] = [not chr(b).isalnum() for b in range(128)]


def _terms(texts: pa.Array) -> Iterator[np.ndarray]:
    return document_words(texts, lower=True, gap=GAP)


def _blocks(vocabulary):
    """Blocks of documents (sorted by id) as flat lists: ids, terms per document, then (term, document, tf) by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(vocabulary.value, dtype=np.uint64)
        ids: list[int | None] = []
        lengths: list[int] = []
        term: list[np.ndarray] = []
        tf: list[np.ndarray] = []
        size = 0

        def emit():
            nonlocal size
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order))
            doc = np.repeat(rank, [len(t) for t in term])
            terms, counts = np.concatenate(term), np.concatenate(tf)
            by = np.lexsort((doc, terms))
            columns = [
                pa.array([ids[i] for i in order], pa.int64()), pa.array([lengths[i] for i in order], pa.int64()),
                pa.array(terms[by]), pa.array(doc[by]), pa.array(counts[by]),
            ]
            ids.clear(), lengths.clear(), term.clear(), tf.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
                names=["ids", "lengths", "term", "doc", "tf"],
            )

        for batch in batches:
            for doc_id, words in zip(integers(batch.column(0)), _terms(batch.column(1))):
                if not len(words):
                    continue
                ids.append(doc_id)
                lengths.append(len(words))
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                found, n = np.unique(at[known[at] == words], return_counts=True)
                term.append(found.astype(np.int32))
                tf.append(n.astype(np.int64))
                size += len(found)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield emit()
        if ids:
            yield emit()

    return run


_BLOCK = "ids array<long>, lengths array<long>, term array<int>, doc array<int>, tf array<long>"


class PostingLists:
    """The posting lists of one block: documents, impacts, and sparse tables over places of the largest impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.names, start = np.unique(term, return_index=True)
        self.cuts = np.append(start, len(term))
        self.doc, self.impact = doc, impact
        self.tables: dict[int, tuple] = {}

    def of(self, term: int):
        """(documents, impacts, table) of a term, or None; row k of the table holds places of maxima of 2^k postings."""
        if term not in self.tables:
            at = int(np.searchsorted(self.names, term))
            if at == len(self.names) or self.names[at] != term:
                self.tables[term] = None
            else:
                part = slice(self.cuts[at], self.cuts[at + 1])
                impact = self.impact[part]
                table = [np.arange(len(impact), dtype=np.int32)]
                while 2 << (len(table) - 1) <= len(impact):
                    last, step = table[-1], 1 << (len(table) - 1)
                    left, right = last[:-step], last[step:]
                    table.append(np.where(impact[left] >= impact[right], left, right))
                self.tables[term] = (self.doc[part], impact, table)
        return self.tables[term]


def _best_places(impact: np.ndarray, table: list[np.ndarray], first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of the largest impact in [first, end) for every range; ranges are not empty."""
    level = np.frexp((end - first).astype(np.float64))[1] - 1
    place = np.empty(len(first), dtype=np.int64)
    for k in np.unique(level):
        of = level == k
        left, right = table[k][first[of]], table[k][end[of] - (1 << k)]
        place[of] = np.where(impact[left] >= impact[right], left, right)
    return place


def search_block(lists: PostingLists, ids: np.ndarray, item: list[tuple[int, int]], most: int, least: int, steps: int | None = None):
    """(scores, documents) of the `most` best documents of a block with a score of at least `least`, best first.

    `item`: (term, times weight is counted); equal scores go to the smaller id, which is the earlier document. With
    `steps`, only so many rounds of splitting are made, and what is returned are documents with true scores.
    """
    found = [(*lists.of(t), times) for t, times in item if lists.of(t) is not None]
    best_score, best_doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not found:
        return best_score, best_doc
    least = max(least, 1)

    def measured(first: np.ndarray, end: np.ndarray):
        """Bound of every interval and the document of its largest contribution; first, end: places by term."""
        bound = np.zeros(first.shape[1], dtype=np.int64)
        top, split = bound.copy(), bound - 1
        for t, (docs, impact, table, times) in enumerate(found):
            some = np.flatnonzero(end[t] > first[t])
            if not len(some):
                continue
            place = _best_places(impact, table, first[t, some], end[t, some])
            part = impact[place] * times
            bound[some] += part
            more = some[part > top[some]]
            split[more] = docs[place[part > top[some]]]
            top[more] = part[part > top[some]]
        return bound, split

    first = np.zeros((len(found), 1), dtype=np.int64)
    end = np.array([[len(docs)] for docs, *_ in found], dtype=np.int64)
    bound, split = measured(first, end)
    begin = np.zeros(1, dtype=np.int64)  # first document that an interval may hold
    while len(bound) and steps != 0:
        keep = bound >= least
        if len(best_score) == most:  # an equal score counts only for an earlier document
            keep &= (bound > best_score[-1]) | ((bound == best_score[-1]) & (begin < best_doc[-1]))
        first, end, bound, split, begin = first[:, keep], end[:, keep], bound[keep], split[keep], begin[keep]
        if not len(bound):
            break
        take = np.argpartition(-bound, SPLITS - 1)[:SPLITS] if len(bound) > SPLITS else np.arange(len(bound))
        at = split[take]
        score = np.zeros(len(take), dtype=np.int64)
        cut, after = np.empty((len(found), len(take)), dtype=np.int64), np.empty((len(found), len(take)), dtype=np.int64)
        for t, (docs, impact, _, times) in enumerate(found):
            cut[t] = np.searchsorted(docs, at)
            held = docs[np.minimum(cut[t], len(docs) - 1)] == at
            score += np.where(held, impact[np.minimum(cut[t], len(docs) - 1)] * times, 0)
            after[t] = cut[t] + held
        best_score, best_doc = np.append(best_score, score), np.append(best_doc, at)
        good = best_score >= least
        best_score, best_doc = best_score[good], best_doc[good]
        order = np.lexsort((best_doc, -best_score))[:most]
        best_score, best_doc = best_score[order], best_doc[order]
        parts = (np.concatenate([first[:, take], after], axis=1), np.concatenate([cut, end[:, take]], axis=1))
        more_bound, more_split = measured(*parts)
        rest = np.ones(len(bound), dtype=bool)
        rest[take] = False
        first, end = (np.concatenate([x[:, rest], y], axis=1) for x, y in zip((first, end), parts))
        bound, split = np.append(bound[rest], more_bound), np.append(split[rest], more_split)
        begin = np.concatenate([begin[rest], begin[take], at + 1])
        if steps is not None:
            steps -= 1
    return best_score, best_doc


def _searched(given, most: int, steps: int | None):
    """Per block and item, the best documents: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors, weights, documents, occurrences = given.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, term, doc, tf = (batch.column(i)[row].values for i in range(5))
                lengths, term, doc, tf = (np.asarray(x) for x in (lengths, term, doc, tf))
                m = 100 - LENGTH_PART + (LENGTH_PART * lengths * documents) // occurrences
                impact = weights[term] * ((IMPACT * tf) // (1000 * tf + SATURATION * m[doc]))
                lists = PostingLists(term, doc, impact)
                number, docs, scores = [], [], []
                for i, item in enumerate(items):
                    score, at = search_block(lists, ids, item, most, floors[i], steps)
                    number.append(np.full(len(at), i))
                    docs.append(at)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(number), pa.int32()), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores)),
                ], names=["item", "doc_id", "score"])

    return run


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in order, in groups whose texts hold at most about PASS_TERMS terms together."""
    group, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        words = next(_terms(pa.array([row["text"]], pa.string())))
        if not len(words):
            continue
        if group and size + len(words) > PASS_TERMS:
            yield group
            group, size = [], 0
        group.append((row["item_id"], *np.unique(words, return_counts=True)))
        size += len(words)
    if group:
        yield group


def search(
    docs: DataFrame, items: DataFrame, most: int = 10,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of each item, over all documents.

    Null, empty and termless texts hold no term, do not count as documents and find nothing. Every row of `docs` is a
    document, repeated ones too; equal scores go to the smaller doc_id, a null one last. Equal rows of `items` are one
    item, different texts under one item_id are ranked each by itself. Texts are read whole. Terms are told apart by
    64-bit fingerprints. Further columns are ignored, whatever their names; without documents or items there are no rows.

    Items are searched in groups of at most PASS_TERMS terms, which bounds what tasks are sent; each takes one reading of
    the texts. A block of documents is answered in the memory of its postings and their tables.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    ranked = None
    for group in _passes(stage(asked, "search-items")):
        found = _search_pass(given, group, most)
        ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        ranked = given.select(F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    return ranked


def _search_pass(given: DataFrame, group: list[tuple], most: int) -> DataFrame:
    spark = given.sparkSession
    vocabulary = np.unique(np.concatenate([words for _, words, _ in group]))
    send = spark.sparkContext.broadcast
    blocks = stage(given.mapInArrow(_blocks(send(vocabulary.tobytes())), _BLOCK), "search-blocks")
    documents, occurrences = blocks.agg(
        F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y))
    ).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    # one number for every term of the items, as many as PASS_TERMS at most
    for row in blocks.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    documents, occurrences = documents or 0, occurrences or 1
    weights = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    terms = [list(zip(np.searchsorted(vocabulary, words).tolist(), times.tolist())) for _, words, times in group]

    def searched(floors: list[int], steps: int | None) -> DataFrame:
        return blocks.mapInArrow(
            _searched(send((terms, floors, weights, documents, occurrences)), most, steps), "item int, doc_id long, score long"
        )

    def leading(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    # a true score that `most` documents reach is a bound for every block: one number an item
    floors = [0] * len(group)
    sure = leading(searched(floors, PROBE_STEPS)).where(F.col("rank") == most)
    for row in sure.select("item", "score").toLocalIterator():
        floors[row["item"]] = row["score"]
    names = spark.createDataFrame([(i, g[0]) for i, g in enumerate(group)], "item int, item_id long")
    return leading(searched(floors, None)).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
