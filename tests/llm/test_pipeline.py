import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not installed", allow_module_level=True)

import corpus_pipeline
from tests.llm.helpers import components
from tests.llm.test_models import rows
from yieldengine.llm.pieces import encoder
from yieldengine.llm.queries import model_file


def test_two_texts_under_one_id_and_rows_without_an_id(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    item = "rare1 item2 words3 that4 stand5 in6 a7 test8"
    rows = [
        (1, one), (1, two), (2, one), (None, two), (None, three), (None, three + " end"), (None, None), (None, None), (3, ""), (4, ""),
        (5, three[:40] + " " + item), (5, two[::-1]), (None, item), (7, "own text under a hot id")] + [(7, "own text under a hot id")] * 50
    schema = "doc_id long, text string, group int, extra map<string,int>"
    docs = spark.createDataFrame([(i, t, 3, {"a": 1}) for i, t in rows], schema)
    kept = corpus_pipeline.drop_copies(spark, docs.repartition(3), str(tmp_path))
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = [(1, one), (1, two), (None, None), (3, ""), (4, ""), *rows[10:14]]
    third = [x for x in left if x not in expected]
    assert sorted(map(str, left)) == sorted(map(str, expected + third)) and third in ([(None, three)], [(None, three + " end")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(str, [tuple(r) for r in clean])) == sorted(str(r) for r in rows if item not in (r[1] or ""))


def test_stages_keep_clean_documents_and_their_columns(spark, tmp_path):
    documents, labels = rows(900, 7)
    texts = {r[0]: r[1] for r in documents}
    clean = [i for i, q, t in labels if q and not t]
    copied, leaked = clean[:20], clean[20:24]
    item = "rare1 item2 words3 that4 stand5 in6 a7 test8 only9 and10 nowhere11 else12"
    table = [(i, f"{t} {item} and more" if i in leaked else t, *rest) for i, t, *rest in ((r[0], *r[1:5]) for r in documents)]
    table += [(2000 + i, texts[i], "en", "src0", len(texts[i])) for i in copied]
    table += [(5000, None, None, None, None), (5001, "", "en", "src0", 0), (clean[30], texts[clean[30]], "en", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(table, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.exceptAll(before).isEmpty(), name
        kept = spark.createDataFrame(kept.collect(), schema)
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.count() == len(left)
    tossed = {i for i, q, t in labels if not q or t}
    assert len(tossed & set(left)) <= 0.02 * len(tossed)
    expected = set(clean) - set(leaked)
    assert len(expected - set(left)) <= 0.02 * len(expected) and not set(leaked) & set(left)
    assert not {2000 + i for i in copied} & set(left) and {5000, 5001} <= set(left) | tossed
    assert all(own == i for i, (_, own) in components(left.items()).items())

    ids = {r["doc_id"]: (r["n_tokens"], r["piece_ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = encoder(model_file()).model
    assert ids == {i: (len(x), x) for i, t in left.items() for x in [model.encode(t or "")]}
