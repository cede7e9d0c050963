import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import WORD, lower
from yieldengine.llm import ballhash

TESTDATA = "/root/testdata/sf0.001"


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """One (doc_id, fingerprint) a row -> smallest id reachable, comparing all pairs."""
    rows = list(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, p, least.get(find(i))) for i, (doc, p) in enumerate(rows)]


def held(df):
    return sorted(((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in df.collect()), key=str)


def test_components_equal_all_pairs_on_given_texts(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    want = brute_components([(r["doc_id"], simhash(r["text"])) for r in docs.collect()])
    assert held(ballhash.simhash_components(docs)) == sorted(want, key=str)
    assert len({w[2] for w in want}) < len(want)


def test_empty_null_long_repeated_and_clashing(spark, monkeypatch):
    monkeypatch.setattr(ballhash, "PIECE_WORDS", 50)
    long = " ".join(random.Random(3).choices("alpha beta gamma Delta ÉTÉ".split(), k=700))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (7, long), (7, long.upper()),
            (None, "a b c"), (None, "quite another text of some words"), (8, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, print string, component_id int")
    found = held(ballhash.simhash_components(docs))
    assert found == sorted(brute_components([(i, simhash(t)) for i, t in rows]), key=str)
    assert ballhash.simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sizes", [{}, {"SLICE": 1 << 12, "CELLS": 1 << 10, "HOT": 1 << 13}])
def test_links_join_all_within_the_radius(spark, monkeypatch, sizes):
    """A large ball of near fingerprints, chains at the radius and just beyond, and noise; also with slices cut again."""
    for name, value in sizes.items():
        monkeypatch.setattr(ballhash, name, value)
    draw = random.Random(5)

    def flipped(x, k):
        return x ^ sum(1 << b for b in draw.sample(range(64), k))

    centre = draw.getrandbits(64)
    prints = {flipped(centre, draw.randint(0, 3)) for _ in range(150)}
    for distance in (3, 4, 5):
        x = draw.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            x = flipped(x, distance)
    prints |= {draw.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    links = ballhash.near_links(spark.createDataFrame([(p,) for p in signed] * 2, "print long")).collect()
    place = {p: i for i, p in enumerate(signed)}
    a, b = np.array([(place[r["u"]], place[r["v"]]) for r in links]).T
    root, child = ballhash._spanning(a, b, len(prints))
    label = np.arange(len(prints))
    label[child] = root
    want = [c for _, _, c in brute_components(list(enumerate(prints)))]
    assert label.tolist() == want
