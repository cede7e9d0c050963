import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import lower
from yieldengine.llm import spelling


def brute_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def deletions(word):
    return {(word[:i], word[i + 1 :]) for i in range(len(word))}


def single_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(p + s == short for p, s in deletions(long))


def brute(words):
    gaps = {}
    for w in words:
        for i in range(len(w) + 1):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            gaps.setdefault((i, w[:i] + w[i:]), set()).add(w)
    near = {w: set() for w in words}
    for group in gaps.values():
        for a in group:
            near[a] |= {b for b in group if a != b and single_edit(a, b)}
    form, out = {}, {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def held(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_near_means_one_edit():
    draw = random.Random(1)
    words = ["".join(draw.choices("abé", k=draw.randint(5, 8))) for _ in range(300)]
    for m in range(5, 10):
        group = sorted({w for w in words if len(w) in (m - 1, m)})
        i, j, _ = spelling._near(group, group, m)
        want = {(a, b) for a in group for b in group if a != b and max(len(a), len(b)) == m and single_edit(a, b)}
        assert {(group[a], group[b]) for a, b in zip(i, j)} == want


def test_equal_to_brute_force_on_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert held(spelling.spelling_variants(docs)) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("sizes", [{}, {"TILE": 7, "CELLS": 64, "HELD": 5, "LONG": 40}])
def test_hot_blocks_chains_and_edges(spark, monkeypatch, sizes):
    """One block with most words, chains of forms, a word longer than a tile's cells, nulls, repeats, clashing columns."""
    for name, value in sizes.items():
        monkeypatch.setattr(spelling, name, value)
    draw = random.Random(2)
    words = ["hottest" + "".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(60)]
    words += ["chain", "chaina", "chainab", "chainabc", "Été" + "x" * 300, "été" + "x" * 299, "÷×÷×÷", "÷×÷×÷÷", "four"]
    rows = [(i, " ".join(w for w in words for _ in range(draw.choice((1, 3, 9, 27))))) for i in range(5)]
    rows += [(7, None), (8, ""), (None, "chain. CHAIN; chain"), (9, "chain-chain"), (9, "chain-chain")]
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(brute_words(rows))
    assert held(spelling.spelling_variants(docs)) == want
    assert any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
