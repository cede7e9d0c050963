import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components, local_alignment
from yieldengine.llm import decontaminate, setjoin
from yieldengine.llm.components import connected_components

DOCS = "doc_id long, text string, extra string, component_id int, kind int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, chains of edits, shared passages, short sets at the threshold, odd texts."""
    rng = random.Random(4)
    passage, texts = words(rng, 60), []
    base = words(rng, 120)
    texts += [base] * 5 + [edited(rng, base, rng.randrange(1, 7)) for _ in range(60)]
    texts += [words(rng, 20) + passage + words(rng, 20) for _ in range(25)]
    chain = words(rng, 150)
    for _ in range(15):
        chain = edited(rng, chain, 3)
        texts.append(chain)
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 12, 14, 20, 30):
        short = words(rng, n)
        texts += [short, short, short + words(rng, 1), short[:-1], edited(rng, short, 1)]
    texts += [["the"] * n for n in (3, 5, 40)]
    rows = [" ".join(t) for t in texts] + ["", " \n\t ", None, "A b\x0bC d E f", "a B c\x0cD e F", "Ä b c d e", "ä b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7, 3) for i, t in rows], DOCS)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(docs).collect()}


def test_components_are_those_of_all_pairs(spark, corpus):
    assert result(spark, corpus) == components(corpus)


def test_blocks_of_lists_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    assert result(spark, corpus) == components(corpus)


def test_copies_of_a_hot_set_lose_no_link(spark, corpus, monkeypatch):
    monkeypatch.setattr(setjoin, "SHARE", 3)
    assert result(spark, corpus) == components(corpus)


def test_bitmap_grows_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LEAST_BITS", 1 << 15)
    prints = spark.range(5000).select(((F.col("id") - 2500) * 7_919_000_017).alias("print"))
    for rows, bits in ((10, 1 << 15), (5000, 1 << 17)):
        found = np.unpackbits(np.frombuffer(setjoin._bitmap(prints, "print", rows), dtype=np.uint8), bitorder="little")
        assert len(found) == bits
        assert set(np.flatnonzero(found)) == {r["print"] % bits for r in prints.collect()}


def test_any_boundary_gives_the_same_links(spark, corpus, monkeypatch):
    for boundary in (0, 40):
        monkeypatch.setattr(setjoin, "_light_boundary", lambda sizes, length, b=boundary: b)
        assert result(spark, corpus) == components(corpus)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text), (2, text), (None, text), (None, None), (5, None)], "doc_id long, text string")
    got = sorted(setjoin.jaccard_components(docs).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(2, 3, 2), (2, 3, 2), (None, 3, 2), (None, 0, None), (5, 0, 5)], key=str)
    assert setjoin.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, x) for x in range(1001, 1200)]
    edges = spark.createDataFrame([*path, *hub, (5, 5), (None, 3), (3, None), *path], "u long, v long")
    got = {r["u"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}
    assert connected_components(edges.limit(0)).count() == 0


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64)
        window = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        score, first, end = decontaminate.align(item, window)
        assert score == local_alignment(item.tolist(), window.tolist())
        assert score == local_alignment(item.tolist(), window[first:end].tolist())


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(8)
    items = [words(rng, n) for n in (20, 35, 50)] + [["the", "of", "the", "and", "of", "a", "the", "and"]]
    docs = [words(rng, 200) for _ in range(30)] + [["the"] * 300]
    expected = set()
    for number, item in enumerate(items[:3]):
        docs.append(words(rng, 90) + item + words(rng, 90))
        docs.append([w.upper() + "," for w in item])
        docs.append(words(rng, 50) + edited(rng, item, len(item) // 6) + words(rng, 10))
        gone = item[: len(item) // 3] + item[len(item) // 3 + 2 :]
        docs.append(gone)
        expected |= {(len(docs) - k, number) for k in (1, 2, 3, 4)}
        docs.append(item[:5] + words(rng, 100) + item[-5:])  # two short runs are no copy
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[1]))]
    tests = [(i, " ".join(d)) for i, d in enumerate(items)] + [(10, None), (11, "")]
    return (
        spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, item_id string, score double"),
        spark.createDataFrame([(*t, 5) for t in tests], "item_id long, text string, doc_id int"),
        expected | {(None, 1)},
    )


def test_leaks_found_and_clean_documents_left_alone(leaks):
    docs, items, expected = leaks
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == expected


def test_blocks_of_items_find_the_same(leaks, monkeypatch):
    docs, items, expected = leaks
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == expected


def test_items_of_few_or_common_words_are_no_leaks(spark):
    rng = random.Random(2)
    docs = [(i, " ".join([*words(rng, 40, 50), "yes", "of course", *words(rng, 20, 50)])) for i in range(20)]
    docs.append((30, "yes. " * 100_000 + "one very rare7 item8 indeed9"))
    items = [(1, "yes"), (2, "Of course!"), (3, ""), (4, "yes yes yes"), (5, "one very rare7 item8 indeed9"), (6, "one very rare7 item8 indeed9")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got) == [(30, 5, 100_000), (30, 6, 100_000)]


def test_leaks_of_empty_tables(leaks):
    docs, items, _ = leaks
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_long_excerpts_and_repeated_items(spark, monkeypatch):
    rng = random.Random(21)
    short, long = words(rng, 59), words(rng, 300)
    docs = [
        (1, words(rng, 40) + short[:29] + words(rng, 40)), (2, words(rng, 40) + long[100:240]), (3, short[:8] + words(rng, 60)),
        (4, words(rng, 300)), (5, short),
    ]
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(short))] * 3 + [(8, " ".join(long))], "item_id long, text string")
    collected = []
    real = decontaminate._item_words
    monkeypatch.setattr(decontaminate, "_item_words", lambda texts: collected.extend(texts) or real(texts))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(1, 7)] * 3 + [(2, 8)] + [(5, 7)] * 3
    assert len(collected) == 2  # a repeated item is collected once
