"""N-gram Jaccard join: size-aware heavy-light join over 5-word shingle sets, at 100 |x & y| >= 80 |x | y|.

Sets are ordered by one global order (frequent shingles last). With overlap at least a(n) = ceil(0.8 n) for a set of n,
two linked sets share at least k shingles among the first n - a(n) + k of each. Light sets (n up to a boundary) are
joined on every 2-subset of that prefix with k = 2; heavy sets, and the light ones within a factor 0.8 of the boundary,
on inverted lists of the single shingles of the prefix with k = 1. The boundary is the size at which listing subsets
starts to cost more than scanning lists, from the size histogram and the mean list length of the data at hand.

Equal sets are one class from the start. Every member of a list is first held against one pivot: the member with the
fewest rarer shingles, which in a group of edited copies is the one nearest to their origin; classes found linked are then one component, and only lists that still touch several
components are compared pair by pair, in blocks. All links between components are thus either verified or ruled out by size, position and the overlap of the
prefixes, and no group is expanded into its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.components import connected_components
from yieldengine.llm.textscan import document_words, integers, mix, shingle_set
from yieldengine.staging import stage

WORDS = 5
PERCENT = 80
#: A shingle seen so often among about WINDOW successive ones is counted; the order of the others is by fingerprint alone.
REPEATED, WINDOW = 3, 2_000_000
#: At most so many of the most frequent shingles are told apart by the global order (any order gives the same links).
ORDERED = 200_000
#: Members of one block of an inverted list, and cells of a pair matrix (or pairs of an output batch) held at a time.
BLOCK, CELLS = 4096, 100_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _least_overlap(n):
    return -(-PERCENT * n // 100)


def _signature(shingles: np.ndarray) -> int:
    """Fingerprint of a set: a sum over its members, so it depends on the set alone."""
    return int(mix(np.sum(mix(shingles ^ _SALT), keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document (kind 0): id, set fingerprint, set size; per repeated shingle of a window (kind 1): shingle, count."""
    shared: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def table(kind: int, ids: list, prints: list, n: list):
        return pa.RecordBatch.from_arrays([
            pa.array([kind] * len(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(n, pa.int64()),
        ], names=["kind", "doc_id", "print", "n"])

    def repeated():
        nonlocal held
        values = np.sort(np.concatenate(shared))
        head = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        counts = np.diff(np.append(head, len(values)))
        often = counts >= REPEATED
        shared.clear()
        seen.clear()
        held = 0
        return table(1, [None] * int(often.sum()), values[head[often]].view(np.int64).tolist(), counts[often].tolist())

    for batch in batches:
        prints, sizes = [], []
        for words in document_words(batch.column(1)):
            shingles = shingle_set(words, WORDS)
            sizes.append(len(shingles))
            prints.append(_signature(shingles) if len(shingles) else None)
            if prints[-1] is not None and prints[-1] not in seen:
                seen.add(prints[-1])
                shared.append(shingles)
                held += len(shingles)
        yield table(0, integers(batch.column(0)), prints, sizes)
        if held >= WINDOW:
            yield repeated()
    if shared:
        yield repeated()


def _ordered(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: by rank among the frequent shingles (others first), then by fingerprint."""
    if not len(frequent):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    order = np.where(frequent[at] == shingles, rank[at], 0)
    return shingles[np.argsort(order, kind="stable")]


def _subset_keys(prefix: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(prefix), 1)
    return mix(prefix[i] * _SALT + mix(prefix[j]))


def _postings(order, boundary: int):
    """Posting lists: key, set fingerprint, size, position of the shingle in the set (-1 for a subset key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = (np.frombuffer(x, dtype=t) for x, t in zip(order.value, (np.uint64, np.int64)))
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 500_000:  # only spares work within the task
                seen = set()
            keys, prints, sizes, places = [], [], [], []
            for words in document_words(batch.column(0)):
                shingles = shingle_set(words, WORDS)
                n = len(shingles)
                # two different linked sets share four fifths of at least five shingles
                if n < 4 or (mark := _signature(shingles)) in seen:
                    continue
                seen.add(mark)
                front = _ordered(shingles, frequent, rank)[: n - _least_overlap(n) + 2]
                key = []
                if n <= boundary:
                    key.append(_subset_keys(front))
                    places.append(np.full(len(key[-1]), -1, dtype=np.int32))
                if 100 * n > PERCENT * boundary:
                    key.append(mix(front[:-1] + _SALT))
                    places.append(np.arange(len(front) - 1, dtype=np.int32))
                key = np.concatenate(key)
                keys.append(key)
                prints.append(np.full(len(key), mark, dtype=np.int64))
                sizes.append(np.full(len(key), n, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(prints)),
                    pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)),
                ], names=["key", "print", "n", "place"])

    return run


def _may_link(n1, p1, n2, p2):
    """Whether sizes and positions allow a link whose first shared shingle stands at these positions."""
    least, most = np.minimum(n1, n2), np.maximum(n1, n2)
    rest = np.minimum(n1 - p1, n2 - p2)
    return (100 * least >= PERCENT * most) & ((p1 < 0) | (100 * rest >= PERCENT * (n1 + n2 - rest)))


def _columns(batch: pa.RecordBatch, names) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists sorted by (key, place, print): pairs with the list's first member (kind 0), and every member of a list (kind 1)."""
    pivot = None  # key, print, size, place of the running list; then its last member
    for batch in batches:
        key, mark, n, place = _columns(batch, ("key", "print", "n", "place"))
        if not len(key):
            continue
        if pivot is not None:
            key, mark, n, place = (np.concatenate([x, y]) for x, y in zip(pivot, (key, mark, n, place)))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        carried = 0 if pivot is None else len(pivot[0])
        key, mark, n, place = key[fresh], mark[fresh], n[fresh], place[fresh]
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        member = ~head
        told = member.copy()
        told[:-1] |= member[1:]  # a head with members
        told[: carried if carried > 1 else 0] = member[: carried if carried > 1 else 0] = False  # in an earlier batch
        pairs, told = np.flatnonzero(member), np.flatnonzero(told)
        ok = _may_link(n[pairs], place[pairs], n[first[pairs]], place[first[pairs]])
        a, b = mark[first[pairs[ok]]], mark[pairs[ok]]
        m = len(a)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([0, 1], dtype=np.int32), [m, len(told)])),
            pa.array(np.concatenate([np.zeros(m, dtype=np.int64), key[told]])),
            pa.array(np.concatenate([a, mark[told]])), pa.array(np.concatenate([b, mark[told]])),
            pa.array(np.concatenate([np.zeros(m, dtype=np.int32), n[told]])),
            pa.array(np.concatenate([np.zeros(m, dtype=np.int32), place[told]])),
        ], names=["kind", "key", "a", "b", "n", "place"])
        keep = [first[-1]] if first[-1] == len(key) - 1 else [first[-1], len(key) - 1]
        pivot = [x[keep] for x in (key, mark, n, place)]


def _within_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lists sorted by (key, i, j): possible pairs of different components, within or across two blocks."""
    names = ("key", "i", "j", "block", "print", "component", "n", "place")
    rest = None

    def pairs(key, i, j, block, mark, component, n, place):
        rows = max(1, CELLS // len(mark))  # of the pair matrix at a time
        for x in range(0, len(mark), rows):
            s = slice(x, x + rows)
            ok = (component[s, None] != component[None]) & (mark[s, None] < mark[None])
            if i[0] != j[0]:
                ok &= block[s, None] != block[None]
            one, two = np.nonzero(ok)
            one += x
            ok = _may_link(n[one], place[one], n[two], place[two])
            if ok.any():
                yield np.stack([mark[one[ok]], mark[two[ok]]])

    def emit(parts):
        a, b = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def batches_of(group_columns):
        held, size = [], 0
        for columns in group_columns:
            for found in pairs(*columns):
                held.append(found)
                size += found.shape[1]
                if size >= CELLS:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def groups(columns):
        changed = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns[:3]], axis=0)) + 1
        return np.split(np.arange(len(columns[0])), changed)

    for batch in batches:
        columns = _columns(batch, names)
        if rest is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(rest, columns)]
        if not len(columns[0]):
            continue
        *whole, last = groups(columns)
        yield from batches_of([x[g] for x in columns] for g in whole)
        rest = [x[last] for x in columns]
    if rest is not None:
        yield from batches_of([rest])


def _sets(wanted):
    """(print, n, shingles) of documents whose set may be wanted: a bitmap of fingerprints, false positives allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 500_000:
                seen = set()
            prints, members = [], []
            for words in document_words(batch.column(0)):
                shingles = shingle_set(words, WORDS)
                if len(shingles) < 4:
                    continue
                mark = _signature(shingles)
                at = mark % (8 * len(bits))
                if bits[at >> 3] >> (at & 7) & 1 and mark not in seen:
                    seen.add(mark)
                    prints.append(mark)
                    members.append(shingles.view(np.int64))
            for x in range(0, len(prints), 256):
                some = members[x : x + 256]
                ends = np.cumsum([0, *map(len, some)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints[x : x + 256], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some))),
                ], names=["print", "shingles"])

    return run


#: Bits of the bitmap: SPARE for each fingerprint, within these bounds (1 MB and 32 MB).
LEAST_BITS, MOST_BITS, SPARE = 1 << 23, 1 << 28, 16


def _bitmap(prints: DataFrame, column: str, rows: int) -> bytes:
    """A bitmap over the (at most `rows`) fingerprints of a column. It grows with them up to MOST_BITS, 16 million at
    SPARE bits each; one that is fuller spares less work and changes no result."""
    bits = min(max(1 << (SPARE * rows).bit_length(), LEAST_BITS), MOST_BITS)
    size = 32_768  # bits of one bitmap of the aggregate
    at = F.pmod(F.col(column), F.lit(bits))
    found = (
        prints.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
        .collect()
    )
    out = bytearray(bits // 8)
    for row in found:
        first = (row["bucket"] - 1) * size // 8
        out[first : first + size // 8] = bytes(row["bits"]).ljust(size // 8, b"\0")
    return bytes(out)


def _plausible(pairs: DataFrame, fronts: DataFrame, boundary: int) -> DataFrame:
    """The pairs that their whole prefixes allow to be linked; exact, and far lighter than fetching the sets.

    With c shingles shared by the two prefixes, the overlap is at most c + max(n - prefix length): a shared shingle in the
    prefix that ends first in the global order is in the other prefix too. Light sets have no list of single shingles,
    so their pairs stay.
    """
    def side(name: str, n: str, front: str) -> DataFrame:
        return fronts.select(F.col("print").alias(name), F.col("n").alias(n), F.col("front").alias(front))

    def behind(n: str):
        return F.ceil(F.col(n) * PERCENT / 100).cast("int") - 1  # members after the prefix

    shared = F.size(F.array_intersect("f1", "f2"))
    most = 180 * (shared + F.greatest(behind("n1"), behind("n2")))
    return (
        pairs.join(side("b", "n2", "f2"), "b").join(side("a", "n1", "f1"), "a")
        .where((F.least("n1", "n2") <= boundary) | (most >= PERCENT * (F.col("n1") + F.col("n2"))))
        .select("a", "b")
    )


#: Pairs of one set that are compared with one copy of it.
SHARE = 256


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets reach the threshold, by exact intersection of the shingle arrays.

    The sets are made again from the texts, for the pairs' members only, and dealt out by fingerprint once for both
    sides of the pairs; keeping every document's set instead would take several times the input. A set with more than
    SHARE pairs (the origin of a large group of copies) is dealt out in a copy for each SHARE of them, so no task has
    all; that is at most four copies for SHARE pairs.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("print"))
    wanted = texts.sparkSession.sparkContext.broadcast(_bitmap(ends, "print", 2 * pairs.count()))
    shares = stage(
        ends.groupBy("print").agg(F.count("*").alias("m")).where(F.col("m") > SHARE)
        .select("print", F.ceil(F.col("m") / SHARE).cast("int").alias("copies")),
        "shingle-shares",
    )
    sets = (
        texts.mapInArrow(_sets(wanted), "print long, shingles array<long>").join(shares, "print", "left")
        .select("print", "shingles", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
        .dropDuplicates(["print", "copy"])
    )

    def side(name: str, copy: str, shingles: str) -> DataFrame:
        return sets.select(F.col("print").alias(name), F.col("copy").alias(copy), F.col("shingles").alias(shingles))

    def dealt(rows: DataFrame, name: str, other: str, copy: str) -> DataFrame:
        of = shares.withColumnRenamed("print", name)
        at = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")
        return rows.join(of, name, "left").withColumn(copy, at).drop("copies")

    both = F.size(F.array_intersect("x", "y"))
    return (
        dealt(dealt(pairs, "a", "b", "i"), "b", "a", "j")
        .join(side("b", "j", "y"), ["b", "j"]).join(side("a", "i", "x"), ["a", "i"])
        .where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _list_length(counts: np.ndarray, total: int) -> float:
    """Mean length of a prefix list: over the rarest fifth of all shingle occurrences (`counts`: of repeated shingles).

    A prefix holds a set's rarest shingles, so the hot ones that the mean over all occurrences follows are not in it.
    """
    quota = total * (100 - PERCENT) / 100
    single = min(quota, max(total - counts.sum(), 0.0))
    taken = np.minimum(np.maximum(quota - single - (np.cumsum(counts) - counts), 0.0), counts)
    return float((single + (taken * counts).sum()) / max(quota, 1.0))


def _light_boundary(sizes: list[tuple[int, int]], list_length: float) -> int:
    """The set size up to which 2-subsets of the prefix cost less than scanning inverted lists."""
    gain, best, boundary = 0.0, 0.0, 0
    for n, count in sorted(sizes):
        prefix = n - _least_overlap(n) + 1
        gain += count * (prefix * (1 + list_length) - math.comb(prefix + 1, 2))
        if gain > best:
            best, boundary = gain, n
    return boundary


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links).

    Null and empty texts have no shingles and are linked with nothing. Repeated rows give repeated results. A null id
    stays null, has part in links, and is a component_id only where nothing in its component has an id. Further columns
    are ignored. A table without rows gives none. Sets and shingles are told apart by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    survey = stage(given.mapInArrow(_survey, "kind int, doc_id long, print long, n long"), "shingle-survey")
    documents = survey.where("kind = 0").select("doc_id", "print", "n")

    frequent = (
        survey.where("kind = 1").groupBy("print").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "print").limit(ORDERED).toPandas()
    )
    total = documents.agg(F.sum("n")).first()[0] or 0
    sizes = [tuple(x) for x in documents.where("n between 4 and 256").groupBy("n").count().collect()]
    boundary = _light_boundary(sizes, _list_length(np.sort(frequent["n"].to_numpy(float)), total))
    frequent = frequent.sort_values("print", key=lambda x: x.to_numpy().view(np.uint64))
    order = spark.sparkContext.broadcast((
        frequent["print"].to_numpy(np.int64).view(np.uint64).tobytes(), frequent["n"].to_numpy(np.int64).tobytes(),
    ))

    postings = given.select("text").mapInArrow(_postings(order, boundary), "key long, print long, n int, place int")
    told = stage(
        postings.repartition("key").sortWithinPartitions("key", "place", "print")
        .mapInArrow(_against_pivot, "kind int, key long, a long, b long, n int, place int"),
        "shingle-lists",
    )
    # every member against the one pivot that it shares most lists with; what that leaves open follows below
    pairs = (
        told.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("lists"))
        .groupBy("b").agg(F.max_by("a", F.struct("lists", F.bitwise_not("a"))).alias("a"))
    )
    members = told.where("kind = 1").select("key", F.col("a").alias("print"), "n", "place")

    fronts = stage(
        members.groupBy("print").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("place") >= 0, F.col("key"))).alias("front")),
        "shingle-fronts",
    )
    pairs = stage(_plausible(pairs, fronts, boundary), "shingle-pairs")
    links = stage(_verified(pairs, given.select("text")), "shingle-links")
    linked = stage(connected_components(links), "shingle-components")
    placed = members.join(linked, members["print"] == linked["u"], "left").select(
        "key", "print", "n", "place", F.coalesce("component", "print").alias("component")
    )
    open_lists = (
        placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
        .where("low <> high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    blocks = (
        placed.join(open_lists, "key")
        .withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    )
    more = (
        blocks.select("key", "i", "j", "block", "print", "component", "n", "place")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(_within_lists, "a long, b long").distinct()
    )
    more = stage(_plausible(more, fronts, boundary), "shingle-pairs")
    more = stage(_verified(more, given.select("text")), "shingle-links")
    # the components so far are stars already; only what joins them is new
    stars = linked.where("u <> component").select("u", F.col("component").alias("v"))
    linked = connected_components(stars.unionByName(more))

    classes = documents.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    named = classes.join(linked, classes["print"] == linked["u"], "left").select(
        "print", "least", "m", "u", F.coalesce("component", "print").alias("component")
    )
    smallest = named.where("u is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named = (
        named.where("m > 1 or u is not null").join(smallest, "component", "left")
        .select("print", F.coalesce("smallest", "least").alias("component_id"))
    )
    return documents.join(named, "print", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
