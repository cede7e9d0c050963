"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where over half of the text's 4-word shingles (repeats included) have it set in their XXH64.
Two fingerprints within RADIUS bits of each other have a point within half the radius of both, so every distinct
fingerprint emits all variants within HALF flipped bits, variants are shuffled, and fingerprints that emit the same
variant collide. By the triangle inequality everything that meets in one variant is linked, so a variant yields a star
of links, never its pairs; the links are verified by counting bits and repeated ones dropped.

What is shuffled is not the 2,081 variants of a fingerprint but the fingerprint, once for each slice (leading bits) that
holds any of them, with the flips it has left there; a slice's task makes the variants again. Within a task a slice is
halved bit by bit until its variants fit CELLS, so memory follows neither the slice nor a group of near copies. Slices
over HOT variants are cut by further leading bits first, so no group of copies is bound to one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.components import connected_components
from yieldengine.llm.textscan import LOWER, integers
from yieldengine.staging import stage

WORDS, SEED = 4, 42
RADIUS = 4
HALF = RADIUS // 2
BITS = 64
#: Variants that a slice is meant to hold, that make it be cut again, and that are in memory at a time.
SLICE, HOT, CELLS = 4 << 20, 32 << 20, 1 << 21
#: Leading bits by which a hot slice is cut again.
MORE_BITS = 6
#: Words of one piece of a text whose shingles are hashed at a time.
PIECE_WORDS = 1 << 16

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = LOWER.tobytes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every shingle of a list of at least WORDS words."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(words) - WORDS + 1].tolist(), end[WORDS - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of one text, unsigned; zero without words."""
    counts, total, words = np.zeros(BITS, dtype=np.int64), 0, []
    for found in _WORD.finditer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words.append(found[0])
        if len(words) == PIECE_WORDS:
            h = _hashes(words)
            counts += _bit_counts(h)
            total += len(h)
            words = words[1 - WORDS :]
    if total == 0 and 0 < len(words) < WORDS:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        h = _hashes(words) if len(words) >= WORDS else np.zeros(0, dtype=np.uint64)
    if len(h):
        counts += _bit_counts(h)
        total += len(h)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * counts > total).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(integers(batch.column(0)), pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"]
        )


def _masks(low: int) -> list[np.ndarray]:
    """By the number of flips left: all masks of at most so many of the `low` lowest bits."""
    one = np.uint64(1) << np.arange(low, dtype=np.uint64)
    i, j = np.triu_indices(low, 1)
    none = np.zeros(1, dtype=np.uint64)
    return [none, np.concatenate([none, one]), np.concatenate([none, one, one[i] | one[j]])]


def _weight(low: int) -> np.ndarray:
    """By the number of flips left: how many variants differ in the `low` lowest bits only."""
    return np.cumsum([math.comb(low, k) for k in range(HALF + 1)])


def _copies(first: int, bits: int):
    """Deal fingerprints out to the slices of `bits` more leading bits after the `first` ones that hold variants of theirs."""
    low = BITS - first - bits
    flips = _masks(bits)[HALF]
    used = np.bitwise_count(flips).astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, mark, left = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for x in range(0, len(mark), 1 << 14):
                some = slice(x, x + (1 << 14))
                own = (mark[some].view(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                rest = left[some, None] - used[None]
                row, flip = np.nonzero(rest >= 0)
                at = (part[some][row].astype(np.uint64) << np.uint64(bits)) | (own[row] ^ flips[flip])
                yield pa.RecordBatch.from_arrays([
                    pa.array(at.view(np.int64)), pa.array(mark[some][row]), pa.array(rest[row, flip].astype(np.int8)),
                ], names=["slice", "print", "left"])

    return run


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest with the same components as the given links among n nodes."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    child = np.flatnonzero(label != np.arange(n))
    return label[child], child


def _collisions(mark: np.ndarray, left: np.ndarray, low: int) -> np.ndarray:
    """Pairs (2 x k) that span the components of the fingerprints meeting in variants over the `low` lowest bits."""
    flips = _masks(low)
    keep = np.uint64((1 << low) - 1) if low < BITS else np.uint64(0xFFFFFFFFFFFFFFFF)
    keys, owner = [], []
    for k in range(HALF + 1):
        of = np.flatnonzero(left == k)
        keys.append(((mark[of, None] & keep) ^ flips[k][None]).ravel())
        owner.append(np.repeat(of, len(flips[k])))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    wide = np.uint64(max(1, int(len(mark) - 1).bit_length()))
    # hash and owner in one number sort fast; should two variants share a hash, verification tells and they are sorted in full
    packed = np.sort((keys * _ODD) >> wide << wide | owner.astype(np.uint64))
    hashed, owner_sorted = packed >> wide, (packed & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
    a, b, ok = _stars(hashed, owner_sorted, mark)
    if not ok.all():
        order = np.lexsort((owner, keys))
        a, b, ok = _stars(keys[order], owner[order], mark)
        a, b = a[ok], b[ok]
    a, b = _spanning(a, b, len(mark))
    return np.stack([mark[a], mark[b]])


def _stars(keys: np.ndarray, owner: np.ndarray, mark: np.ndarray):
    """Each run of equal keys as links of its first owner with the others, once each, and whether they are in the radius."""
    same = np.append(False, keys[1:] == keys[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
    at = np.flatnonzero(same)
    links = np.unique(owner[head[at]] * len(mark) + owner[at])
    a, b = links // len(mark), links % len(mark)
    return a, b, np.bitwise_count(mark[a] ^ mark[b]) <= RADIUS


def _slice_links(mark: np.ndarray, left: np.ndarray, low: int) -> Iterator[np.ndarray]:
    """Links of one slice, halved by its next bit as long as its variants are too many to hold."""
    todo = [(mark, left, low)]
    while todo:
        mark, left, low = todo.pop()
        if len(mark) < 2:
            continue
        if _weight(low)[left].sum() <= CELLS or low == 0:
            found = _collisions(mark, left, low)
            if found.size:
                yield found
            continue
        bit = (mark >> np.uint64(low - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            stays = rest >= 0
            todo.append((mark[stays], rest[stays], low - 1))


def _links(low: int):
    """Links within slices of `low` remaining bits, from rows sorted by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit():
            a, b = np.unique(np.concatenate(held, axis=1), axis=1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        def whole(parts):
            mark = np.concatenate([p[0] for p in parts]).view(np.uint64)
            return _slice_links(mark, np.concatenate([p[1] for p in parts]).astype(np.int8), low)

        at, parts = None, []
        for batch in batches:
            slices, mark, left = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero(slices[1:] != slices[:-1]) + 1, [len(slices)]])
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                if parts and slices[x] != at:
                    for found in whole(parts):
                        held.append(found)
                        size += found.shape[1]
                        if size > CELLS // 16:
                            yield emit()
                            size = 0
                    parts = []
                at = slices[x]
                parts.append((mark[x:y].copy(), left[x:y].copy()))
        if parts:
            for found in whole(parts):
                held.append(found)
                size += found.shape[1]
                if size > CELLS // 16:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    return run


_SLICED = "slice long, print long, left byte"


def near_links(prints: DataFrame) -> DataFrame:
    """(u, v): links among the distinct fingerprints of the long column `print` that join all within RADIUS bits.

    Every pair within the radius is joined by a path of verified links; not every such pair is a row.
    """
    alone = prints.where("print is not null").select("print").distinct()
    alone = stage(alone, "simhash-prints")
    variants = alone.count() * int(_weight(BITS)[HALF])
    first = min(24, max(MORE_BITS, math.ceil(math.log2(max(variants, 1) / SLICE)) if variants > SLICE else 0))
    rows = alone.select(F.lit(0).cast("long").alias("slice"), "print", F.lit(HALF).cast("byte").alias("left"))
    rows, found, done = rows.mapInArrow(_copies(0, first), _SLICED), [], first
    while True:
        rows = stage(rows, "simhash-slices")
        low = BITS - done
        weight = F.element_at(F.array(*[F.lit(int(w)) for w in _weight(low)]), F.col("left").cast("int") + 1)
        load = rows.groupBy("slice").agg(F.sum(weight).alias("load"))
        hot = stage(load.where(F.col("load") > HOT).select("slice"), "simhash-hot") if low > MORE_BITS else None
        calm = rows if hot is None else rows.join(hot, "slice", "left_anti")
        links = (
            calm.repartition("slice").sortWithinPartitions("slice").select("slice", "print", "left")
            .mapInArrow(_links(low), "u long, v long")
        )
        found.append(stage(links.distinct(), "simhash-links"))
        if hot is None or not hot.head(1):
            break
        rows = rows.join(hot, "slice", "left_semi").select("slice", "print", "left").mapInArrow(_copies(done, MORE_BITS), _SLICED)
        done += MORE_BITS
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


#: A fingerprint of over one in HOT_SHARE rows is joined by broadcast: there are fewer than HOT_SHARE of them, whatever the table.
HOT_SHARE = 1000


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, print (the fingerprint as a signed long), component_id (smallest doc_id reachable).

    Null, empty and wordless texts have fingerprint zero, linked like any other. Repeated rows give repeated results and
    equal fingerprints are linked. Texts are hashed whole, in pieces, whatever their length. A null id stays null and is a
    component_id only where nothing in its component has an id. Further columns are ignored, whatever their names; a
    table without rows gives none.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = stage(given.mapInArrow(_fingerprints, "doc_id long, print long"), "simhash")
    classes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")), "simhash-classes")
    linked = connected_components(near_links(classes))
    placed = classes.join(linked.withColumnRenamed("u", "print"), "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(placed.join(smallest, "component").select("print", "m", "component_id"), "simhash-names")
    total = classes.agg(F.sum("m")).first()[0] or 0
    hot = F.col("m") * HOT_SHARE > total
    few = F.broadcast(named.where(hot).select("print", F.col("component_id").alias("often")))
    # rows of hot fingerprints are named without a shuffle, the others by their fingerprint
    told = rows.join(few.withColumn("hot", F.lit(True)), "print", "left")
    calm = told.where("hot is null").select("doc_id", "print").join(named.where(~hot).select("print", "component_id"), "print")
    return told.where("hot").select("doc_id", "print", F.col("often").alias("component_id")).unionByName(
        calm.select("doc_id", "print", "component_id")
    )
