import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import lower
from yieldengine.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items, most=10):
    texts = [(doc, Counter(t), len(t)) for doc, text in rows if (t := terms(text))]
    total, df = sum(n for *_, n in texts), Counter(w for _, own, _ in texts for w in own)
    out = {}
    for number, (item, text) in enumerate(sorted(set(items), key=str)):
        ranked = []
        for doc, own, n in texts:
            m = 100 - 75 + (75 * n * len(texts)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * df[w] + 1))) * ((1000000000 * own[w]) // (1000 * own[w] + 8 * m))
                for w in terms(text) if own[w]
            )
            if score:
                ranked.append((-score, doc is None, doc, score))
        ranked.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out[number] = [(item, i, r[2], r[3]) for i, r in enumerate(ranked[:most], 1)]
    return sorted((x for rows in out.values() for x in rows), key=str)


def held(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_equal_to_brute_force_on_given_texts(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = held(lexical.search(docs, items))
    assert found == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(r[1] == 10 for r in found)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_DOCS": 7, "SPLITS": 2, "PROBE_STEPS": 1, "PASS_TERMS": 12}])
def test_ties_repeats_nulls_and_long_texts(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(4)
    words = "red Green blue café 数据 x1 y-z".split()
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 9)))) for i in range(80)]
    rows += [(i, "red red blue") for i in range(100, 130)] + [(5, "red red blue"), (5, "red red blue"), (None, "red red blue")]
    rows += [(200, None), (201, ""), (202, "?!"), (203, "blue " * 50_000), (None, "café only")]
    items = [(1, "Red, blue; red"), (2, "CAFÉ 数据"), (3, "nowhere to be found"), (4, None), (5, ""), (6, "z y x1 green red"), (6, "z"), (1, "Red, blue; red")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, score int, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert held(lexical.search(docs, asked)) == brute(rows, items)
    assert lexical.search(docs.limit(0), asked).collect() == lexical.search(docs, asked.limit(0)).collect() == []


def test_intervals_that_cannot_reach_the_best_are_not_split():
    """Most documents of a block are never scored, and the ten best equal plain scoring."""
    draw = np.random.default_rng(1)
    size, lists = 4000, []
    for t in range(12):
        doc = np.sort(draw.choice(size, size=60 * (t + 1), replace=False))
        lists.append((np.full(len(doc), t), doc, draw.integers(1, 100_000 // (t + 1), len(doc))))
    term, doc, impact = (np.concatenate(x) for x in zip(*lists))
    item = [(t, 1 + t % 2) for t in range(12)]
    plain = np.zeros(size, dtype=np.int64)
    np.add.at(plain, doc, impact * (1 + term % 2))
    want = np.lexsort((np.arange(size), -plain))[:10]
    seen = []
    kept = lexical.np.searchsorted
    made = lexical.PostingLists(term, doc, impact)
    try:
        lexical.np.searchsorted = lambda a, v, *k: (seen.append(np.size(v)), kept(a, v, *k))[1]
        score, at = lexical.search_block(made, np.arange(size), item, 10, 0)
    finally:
        lexical.np.searchsorted = kept
    assert at.tolist() == want.tolist() and score.tolist() == plain[want].tolist()
    assert sum(seen) / 12 < size / 2
