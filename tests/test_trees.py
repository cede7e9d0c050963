import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldengine.ml import artifacts, evaluation, regression, trees
from yieldengine.ml.trees import Ensemble, Growth, Softmax, Squared, Task, TreeModel, Votes


@pytest.fixture(scope="module")
def signal(spark):
    """3,000 rows with a step, an interaction and noise; part -1 is held out, the others are three folds."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(3000, 4)).round(2)
    y = 90 + 3 * (x[:, 0] > 0.3) + 2 * x[:, 1] * (x[:, 2] > 0) + draw.normal(size=3000) * 0.5
    rows = [(i, int(i % 4) - 1, *map(float, r), float(t), int(t > 91) + int(t > 93)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, part int, a double, b double, c double, d double, y double, k int")
    return df.withColumn("key", F.xxhash64("key")).withColumn("w", F.lit(1.0)).repartition(3).cache()


FEATURES = ["a", "b", "c", "d"]


def grown(signal, *models, bins=64):
    edges = trees.bin_edges(signal, FEATURES, bins)
    table = trees.training_table(signal, FEATURES, edges, [b for m in models for b in m.base])
    trees.train(table, list(models))
    return table, edges


def boosted(**more):
    given = {"loss": Squared(), "growth": Growth(4, 3, 5), "trees": 6, "rate": 0.3, "rows": 0.8, "leave_out": (-1,), "base": [91.0]}
    return Ensemble(**(given | more))


def test_leaf_values_and_gains_follow_the_closed_form():
    """Four residuals, one feature: with l1 = 0.5 and l2 = 1 a leaf is (|sum| - 0.5) / (n + 1) with its sign."""
    x = np.array([[0], [0], [1], [1]], dtype=np.uint16)
    g = np.array([[-3.0], [-1.0], [2.0], [4.0]])
    growth = Growth(1, l1=0.5, l2=1.0)
    nodes = trees.grow_subtree(x, g, np.ones((4, 1)), 1, Task(0, 1, growth))
    assert nodes["place"].tolist() == [1, 2, 3] and nodes["feature"].tolist() == [0, -1, -1] and nodes["cut"][0] == 0
    assert growth.value(nodes["sums"][:, :1], nodes["sums"][:, 1:2])[:, 0] == pytest.approx([1.5 / 5, -3.5 / 3, 5.5 / 3])
    assert nodes["gain"][0] == pytest.approx(3.5**2 / 3 + 5.5**2 / 3 - 1.5**2 / 5)
    assert trees.grow_subtree(x, g, np.ones((4, 1)), 1, Task(0, 1, Growth(1, min_leaf=3)))["feature"].tolist() == [-1]
    assert trees.grow_subtree(x, g, np.ones((4, 1)), 1, Task(0, 1, Growth(1, min_weight=2.5)))["feature"].tolist() == [-1]
    assert trees.grow_subtree(x, g, np.ones((4, 1)), 1, Task(0, 1, Growth(1, min_split=5)))["feature"].tolist() == [-1]


def test_a_split_is_the_best_of_all(monkeypatch):
    """Searched by cells and by rows, against every cut tried one by one."""
    draw = np.random.default_rng(2)
    x = draw.integers(0, 9, (60, 3)).astype(np.uint16)
    g, h = draw.normal(size=(60, 2)), draw.uniform(0.5, 1, (60, 2))
    growth = Growth(1, min_leaf=4, l2=0.3)
    worth = lambda of: growth.gain(g[of].sum(0), h[of].sum(0))
    tried = {}
    for f in range(3):
        for cut in range(8):
            left = x[:, f] <= cut
            if 4 <= left.sum() <= 56:
                tried[f, cut] = worth(left) + worth(~left) - worth(np.ones(60, bool))
    best = max(tried.values())
    for cells in (True, False):
        if not cells:
            monkeypatch.setattr(trees, "_best_by_cells", lambda s, n, v, b, t, w, gr, k: trees._best_by_rows(s, n, v, np.argsort(v, kind="stable"), t, w, gr, k))
        nodes = trees.grow_subtree(x, g, h, 1, Task(0, 1, growth))
        assert nodes["gain"][0] == pytest.approx(best) and tried[nodes["feature"][0], nodes["cut"][0]] == pytest.approx(best)


def test_levels_and_subtrees_grow_the_same_trees(signal, monkeypatch):
    """All by levels with siblings by subtraction, some levels, none: the bound on local rows moves work only."""
    def make():
        return [
            boosted(), Ensemble(Squared(), Growth(6, 2, 5, node_columns=2), 4, bagged=True, base=[0.0], leave_out=(-1,)),
        ]

    kept = {}
    for bound in (1 << 16, 500, 20):
        monkeypatch.setattr(trees, "LOCAL_ROWS", bound)
        monkeypatch.setattr(trees, "HELD_BYTES", 1 << 16)
        models = make()
        grown(signal, *models)
        kept[bound] = models
    for bound in (500, 20):
        for a, b in zip(kept[1 << 16], kept[bound]):
            assert len(a.done) == len(b.done) == a.trees
            for s, t in zip(a.done, b.done):
                assert s.place.tolist() == t.place.tolist() and s.feature.tolist() == t.feature.tolist()
                assert s.value == pytest.approx(t.value, abs=1e-9) and s.gain == pytest.approx(t.gain, abs=1e-6)


def test_a_level_and_the_subtrees_of_a_round_are_a_job_each(signal, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 300)
    model, context = boosted(trees=4, growth=Growth(3, 3, 5)), signal.sparkSession.sparkContext
    table = trees.training_table(signal, FEATURES, trees.bin_edges(signal, FEATURES, 64), model.base)
    context.setJobGroup("rounds", "rounds of boosting")
    try:
        trees.train(table, [model])
        jobs = len(context.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.done) == 4 and 4 * 2 <= jobs <= 4 * 5  # levels of the nodes and of the leaves, and the subtrees


def test_folds_in_shared_passes_equal_separate_fits(signal):
    together = [boosted(), boosted(leave_out=(-1, 1)), boosted(growth=Growth(3, l2=1.0, tree_columns=2), seed=7)]
    alone = [boosted(), boosted(leave_out=(-1, 1)), boosted(growth=Growth(3, l2=1.0, tree_columns=2), seed=7)]
    grown(signal, *together)
    for model in alone:
        grown(signal.repartition(5), model)
    for a, b in zip(together, alone):
        for s, t in zip(a.done, b.done):
            assert s.feature.tolist() == t.feature.tolist() and s.value == pytest.approx(t.value, abs=1e-9)


def test_scores_in_the_table_are_the_models_predictions(signal):
    model = boosted(trees=trees.PENDING + 3)
    table, edges = grown(signal, model)
    own = TreeModel.of(model, FEATURES, edges)
    kept = {r["key"]: r["score_0"][0] for r in trees.scores(table, [1]).collect()}
    told = {r["key"]: r["prediction"] for r in own.transform(signal).select("key", "prediction").collect()}
    assert kept == pytest.approx(told)
    again = TreeModel.from_table(own.table(signal.sparkSession).repartition(3))
    assert {r["key"]: r["prediction"] for r in again.transform(signal).select("key", "prediction").collect()} == told
    assert again.importances == pytest.approx(own.importances) and sum(own.importances) == pytest.approx(1)
    assert own.importances.argmin() == 3  # d has no part in y


def test_boosting_and_forest_fit_as_well_as_spark_ml(signal):
    """Held-out r2 within 0.03 and mean absolute error within 0.05 of Spark's trees with the same parameters."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(signal)
    train, test = rows.where("part >= 0"), rows.where("part < 0")
    spec = regression.TrainingSpec(boost_rounds=30, boost_depth=4, boost_rate=0.1, forest_trees=30, forest_depth=7, folds=1, max_bins=64)
    data = signal.withColumn(regression.TARGET, F.col("y"))
    fits = [regression.Fit(n, None, (-1,), (-1,)) for n in ("GradientBoosting", "RandomForest")]
    own = regression.fit_all(fits, spec, FEATURES, data)
    theirs = [
        GBTRegressor(labelCol="y", maxIter=30, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=3, maxBins=64, seed=1),
        RandomForestRegressor(labelCol="y", numTrees=30, maxDepth=7, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxBins=64, seed=1),
    ]
    for fitted, other in zip(own, theirs):
        want = evaluation.regression_metrics(other.fit(train).transform(test), "y", "prediction").first()
        assert fitted.held["r2"] == pytest.approx(want["r2"], abs=0.03) and fitted.held["mae"] == pytest.approx(want["mae"], abs=0.05)


def test_classes_by_softmax_and_by_votes(signal, spark):
    classes = signal.withColumn("y", F.col("k").cast("double"))
    models = [
        Ensemble(Softmax(3), Growth(4, l2=1.0, most=10.0), 12, 0.3, leave_out=(-1,), base=[0.0] * 3),
        Ensemble(Votes(3), Growth(8, 2, 5, node_columns=2), 15, bagged=True, weighted=True, leave_out=(-1,), base=[0.0] * 3),
    ]
    table, edges = grown(classes, *models)
    test = classes.where("part < 0")
    common = test.groupBy("k").count().agg(F.max("count") / F.sum("count")).first()[0]
    for model in models:
        scored = TreeModel.of(model, FEATURES, edges).transform(test)
        row = scored.agg(
            F.avg((F.col("prediction") == F.col("k")).cast("double")).alias("hit"),
            F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1)).alias("off"),
        ).first()
        assert row["hit"] > common + 0.25 and row["off"] < 1e-9
    nothing = TreeModel("votes", FEATURES, [0.0] * 3, [], [])
    assert nothing.transform(test).select("probability").first()[0] == pytest.approx([1 / 3] * 3)


def test_models_that_are_left_no_rows_give_their_start(signal):
    parts = (-1, 0, 1, 2)
    models = [
        boosted(trees=2, leave_out=parts), Ensemble(Squared(), Growth(3), 2, bagged=True, base=[0.0], leave_out=parts),
        Ensemble(Softmax(3), Growth(3), 2, leave_out=parts, base=[0.5] * 3), Ensemble(Votes(3), Growth(3), 2, bagged=True, leave_out=parts, base=[0.0] * 3),
    ]
    table, _ = grown(signal, *models)
    row = trees.scores(table, [1, 1, 3, 3]).first()
    assert (row["score_0"], row["score_1"], row["score_2"], row["score_3"]) == ([91.0], [0.0], [0.5] * 3, [0.0] * 3)


def test_no_rows_and_constant_rows(spark):
    schema = "key long, part int, a double, b double, c double, d double, y double, w double"
    for rows in ([], [(i, 0, 1.0, 1.0, 1.0, 1.0, 5.0, 1.0) for i in range(20)]):
        models = [boosted(trees=2), Ensemble(Squared(), Growth(3), 2, bagged=True, base=[0.0], leave_out=(-1,))]
        table, _ = grown(spark.createDataFrame(rows, schema), *models)
        assert all(t.feature.tolist() == [-1] for m in models for t in m.done)
        assert trees.scores(table, [1, 1]).count() == len(rows)


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path):
    store = str(tmp_path / "store")
    table = spark.createDataFrame([(1,)], "n int")
    first = artifacts.write_version(spark, store, lambda folder: table.write.parquet(f"{folder}/t"))

    def dies(folder):
        spark.createDataFrame([(2,)], "n int").write.parquet(f"{folder}/t")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        artifacts.write_version(spark, store, dies)
    assert artifacts.current(spark, store).endswith(first)
    assert spark.read.parquet(f"{artifacts.current(spark, store)}/t").first()["n"] == 1
    second = artifacts.write_version(spark, store, lambda folder: table.write.parquet(f"{folder}/u"), artifacts.current(spark, store))
    assert artifacts.committed_versions(spark, store) == [first, second]
    assert spark.read.parquet(f"{artifacts.current(spark, store)}/t").count() == 1  # kept beside what is new
    assert artifacts.remove_old_versions(spark, store, 1) == [first] and artifacts.committed_versions(spark, store) == [second]
    assert artifacts.current(spark, str(tmp_path / "none")) is None


def test_siblings_by_subtraction_grow_the_subtrees_that_sums_do(monkeypatch):
    draw = np.random.default_rng(5)
    x = np.minimum(draw.geometric(0.1, (4000, 4)), 40).astype(np.uint16)
    g = ((x[:, :1] > 3) + 0.2 * (x[:, 1:2] > 9) * (x[:, 2:3] > 2) + draw.normal(size=(4000, 1)) * 0.3)
    for h, growth in ((np.ones((4000, 1)), Growth(7, 3, 5)), (draw.uniform(0.5, 1, (4000, 1)), Growth(7, min_weight=2.0, l2=1.0, tree_columns=3))):
        grown = {}
        for kept in (0, 1 << 18):
            monkeypatch.setattr(trees, "KEPT_CELLS", kept)
            monkeypatch.setattr(trees, "SUMMED_ROWS", 0)
            grown[kept] = trees.grow_subtree(x, g, h, 1, Task(0, 1, growth))
        summed, taken = grown.values()
        assert len(summed["place"]) > 40
        for name in ("place", "feature", "cut"):
            assert summed[name].tolist() == taken[name].tolist()
        assert summed["gain"] == pytest.approx(taken["gain"], abs=1e-8) and summed["sums"] == pytest.approx(taken["sums"])
        monkeypatch.undo()


def test_rows_of_subtrees_travel_without_their_gradients():
    """A bagged row takes its bins, target and number of draws; classes, scores and gradients are made where it arrives."""
    n = 2000
    draw = np.random.default_rng(6)
    rows = trees.Rows(
        0, draw.integers(0, 1 << 63, n).astype(np.uint64), draw.integers(0, 256, (n, 8)).astype(np.uint16), draw.normal(size=n), np.ones(n),
        np.zeros(n, np.int32), np.zeros((n, 7)),
    )
    models = [Ensemble(Squared(), Growth(5), 1, bagged=True, base=[0.0]), Ensemble(Softmax(6), Growth(5), 1, base=[0.0] * 6)]
    growing, tasks = trees.Growing(models), [Task(0, 3, models[0].growth), Task(1, 3, models[1].growth)]
    for t, most in ((0, 17), (1, 65)):
        (_, (_, *cells)), = trees._local_rows(growing, tasks, [None, None], [(0, t, 1)], 256)(iter([rows]))
        assert sum(c.nbytes for c in cells) <= most * len(cells[0])
        index, *given = growing.drawn(rows, tasks[t])
        want = trees.grow_subtree(rows.x[index], *growing.sums(*given, tasks[t]), 1, tasks[t])
        (_, told), = trees._subtrees(growing, tasks, [(t, 1)])(iter([(0, (0, *cells))]))
        assert told["feature"].tolist() == want["feature"].tolist() and told["sums"] == pytest.approx(want["sums"])


def test_drawn_features_are_summed_alone_and_split_alike(monkeypatch):
    """A node that may be split on two of eight features has its rows summed for those two, with the same tree as before."""
    draw = np.random.default_rng(9)
    x = np.minimum(draw.geometric(0.05, (20000, 8)), 200).astype(np.uint8)
    y = 2.0 * (x[:, 0] > 9) + (x[:, 3] > 20) * (x[:, 5] > 4) + draw.normal(size=20000)
    w = 1.0 + draw.poisson(1, 20000)
    task = Task(0, 4, Growth(9, 2, 5, node_columns=2))
    summed, by_cell = [], trees._by_cell
    monkeypatch.setattr(trees, "_by_cell", lambda sums, cell, size: summed.append(len(cell)) or by_cell(sums, cell, size))
    grown, asked = {}, {}
    for bound in (1 << 30, 500):
        monkeypatch.setattr(trees, "PICKED_ROWS", bound)
        summed.clear()
        grown[bound] = trees.grow_subtree(x, (y * w)[:, None], w[:, None], 1, task)
        asked[bound] = max(summed), sum(summed)
    whole, picked = grown.values()
    assert len(whole["place"]) > 100 and asked[500][0] == 20000 and asked[500][1] <= (3 * 9 + 1) * 20000
    for name in ("place", "feature", "cut"):
        assert whole[name].tolist() == picked[name].tolist()
    assert whole["gain"] == pytest.approx(picked["gain"], abs=1e-6) and whole["sums"] == pytest.approx(picked["sums"])


def test_votes_of_many_rows_are_summed_without_a_column_a_class(monkeypatch):
    draw = np.random.default_rng(10)
    x = np.minimum(draw.geometric(0.05, (9000, 6)), 200).astype(np.uint8)
    y = (draw.integers(0, 4, 9000) + (x[:, 0] > 9) * 1.0) % 5
    y[:7] = [-1.0, 5.0, 2.5, np.nan, 7.0, 0.0, 4.0]  # of no class, but rows all the same
    w = draw.uniform(0.5, 2, 9000) * (1 + draw.poisson(1, 9000))
    for node_columns in (2, None):
        model = Ensemble(Votes(5), Growth(8, 2, 5, node_columns=node_columns), 1, bagged=True, weighted=True, base=[0.0] * 5)
        growing, task, grown = trees.Growing([model]), Task(0, 4, model.growth), []
        for bound in (1 << 30, 500):
            monkeypatch.setattr(trees, "PICKED_ROWS", bound)
            sums = growing.subtree_sums(y, w, np.zeros((9000, 0)), task)
            assert isinstance(sums[0], trees.Shares) == (bound == 500)
            grown.append(trees.grow_subtree(x, *sums, 1, task))
        assert len(grown[0]["place"]) > 60
        for name in ("place", "feature", "cut"):
            assert grown[0][name].tolist() == grown[1][name].tolist()
        assert grown[0]["sums"] == pytest.approx(grown[1]["sums"])


def test_models_of_one_seed_draw_the_rows_once(monkeypatch):
    n, draw = 500, np.random.default_rng(11)
    rows = trees.Rows(
        0, draw.integers(0, 1 << 63, n).astype(np.uint64), np.zeros((n, 2), np.uint16), np.zeros(n), np.ones(n),
        draw.integers(-1, 4, n).astype(np.int32), np.zeros((n, 4)),
    )
    hashed, uniform = [], trees._uniform
    monkeypatch.setattr(trees, "_uniform", lambda key, seed: hashed.append(seed) or uniform(key, seed))
    models = [boosted(leave_out=(-1, k)) for k in range(4)] + [Ensemble(Squared(), Growth(3), 2, bagged=True, leave_out=(-1, k)) for k in range(4)]
    drawn = [m.drawn(rows, 42) for m in models]
    assert hashed == [42]
    share = uniform(rows.key, 42)
    for m, (index, times) in zip(models, drawn):
        used = ~np.isin(rows.part, m.leave_out)
        want = np.searchsorted(trees._POISSON, share) if m.bagged else (share < 0.8).astype(int)
        assert index.tolist() == np.flatnonzero(used & (want > 0)).tolist() and times.tolist() == want[index].tolist()


def test_large_nodes_of_enough_trees_are_grown_in_one_job(signal, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 800)
    context = signal.sparkSession.sparkContext
    model = Ensemble(Squared(), Growth(6, 2, 5, node_columns=2), context.defaultParallelism, bagged=True, base=[0.0], leave_out=(-1,))
    table = trees.training_table(signal, FEATURES, trees.bin_edges(signal, FEATURES, 64), model.base)
    context.setJobGroup("forest", "a forest")
    try:
        trees.train(table, [model])
        jobs = len(context.statusTracker().getJobIdsForGroup("forest"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and len(model.done) == context.defaultParallelism and all(len(t.place) > 20 for t in model.done)


def test_blocks_keep_few_bins_in_a_byte_and_residuals_alone_travel(signal):
    model = boosted()
    for bins, width in ((64, 1), (1000, 2)):
        table = trees.training_table(signal, FEATURES, trees.bin_edges(signal, FEATURES, bins), model.base)
        assert {(rows.x.dtype.itemsize, rows.x.shape[1]) for rows in table.rows.collect()} == {(width, 4)}
    (rows, *_), task = table.rows.collect(), Task(0, 3, model.growth)
    growing = trees.Growing([model])
    index, y, w, score = growing.drawn(rows, task)
    assert score.shape == (len(index), 0) and y.tolist() == (rows.y - 91.0)[index].tolist()
    g, h = growing.sums(y, w, score, task)
    assert g[:, 0].tolist() == y.tolist() and (h == 1).all()


def test_of_two_large_siblings_one_is_summed(signal, monkeypatch):
    """Below the root a level sums the child of fewer rows and takes its sibling from the parent, with the trees that sums of both give."""
    monkeypatch.setattr(trees, "LOCAL_ROWS", 100)
    monkeypatch.setattr(trees, "SUMMED_ROWS", 0)
    wanted, histograms = [], trees._part_histograms
    monkeypatch.setattr(trees, "_part_histograms", lambda growing, tasks, x, big, *rest: wanted.append(list(big)) or histograms(growing, tasks, x, big, *rest))
    kept = {}
    for held in (0, 1 << 26):
        monkeypatch.setattr(trees, "DRIVER_BYTES", held)
        wanted.clear()
        models = [boosted(trees=2), boosted(trees=2, seed=7, leave_out=(-1, 1), growth=Growth(4, l2=1.0, min_weight=2.0, tree_columns=3))]
        grown(signal, *models)
        kept[held] = models, [len(set(big)) - len({(t, place >> 1) for t, place in big}) for big in wanted]
    (summed, pairs), (taken, single) = kept.values()
    assert max(pairs) > 1 and max(single) == 0 and len(pairs) == len(single)
    for a, b in zip(summed, taken):
        for s, t in zip(a.done, b.done):
            assert s.place.tolist() == t.place.tolist() and s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
            assert s.value == pytest.approx(t.value, abs=1e-9) and s.gain == pytest.approx(t.gain, abs=1e-6)


def test_passes_of_a_round_read_the_drawn_rows_alone(signal):
    models = [boosted(), boosted(leave_out=(-1, 1)), Ensemble(Softmax(3), Growth(3), 2, leave_out=(-1,), base=[0.0] * 3)]
    table = trees.training_table(signal, FEATURES, trees.bin_edges(signal, FEATURES, 64), [b for m in models for b in m.base])
    growing, tasks = trees.Growing(models), [Task(i, 5, m.growth) for i, m in enumerate(models)]
    for rows in table.rows.collect():
        for some in (tasks[:2], tasks):
            kept = growing.round(rows, some)
            assert len(kept.x) == np.logical_or.reduce([growing.fits(rows, t) for t in some]).sum() < len(rows.x)
            for task in some:
                index, *given = growing.drawn(rows, task)
                own, *told = growing.drawn(kept, task)
                assert kept.x[own].tolist() == rows.x[index].tolist() and all(a.tolist() == b.tolist() for a, b in zip(given, told))


def test_what_a_pass_has_shuffled_is_removed(signal, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 300)
    monkeypatch.setattr(trees, "DRIVER_BYTES", 0)
    env = signal.sparkSession._jvm.org.apache.spark.SparkEnv.get()
    table = trees.training_table(signal, FEATURES, trees.bin_edges(signal, FEATURES, 64), [91.0])
    table.rows.count()
    shuffled = lambda: {b for b in env.blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, model = shuffled(), boosted(trees=3)
    trees.train(table, [model])
    table.rows.count()
    ends = time.time() + 20
    while shuffled() - before and time.time() < ends:
        time.sleep(0.2)
    assert len(model.done) == 3 and not shuffled() - before


def test_a_model_is_stored_and_sent_in_parts(signal, monkeypatch, tmp_path):
    """No task is sent, no job returns and no task holds more than a part of the trees; scores are the same."""
    spark, classes = signal.sparkSession, signal.withColumn("y", F.col("k").cast("double"))
    model = Ensemble(Votes(3), Growth(8, 2, 5, node_columns=2), 12, bagged=True, leave_out=(-1,), base=[0.0] * 3)
    _, edges = grown(classes, model)
    own = TreeModel.of(model, FEATURES, edges)
    told = lambda m: {r["key"]: r["probability"] for r in m.transform(classes).select("key", "probability").collect()}
    whole = told(own)
    size = max(cut.nbytes + t.feature.nbytes + t.left.nbytes + t.value.nbytes for t, cut in zip(own.trees, own.thresholds))
    monkeypatch.setattr(trees, "PART_BYTES", 3 * size)
    monkeypatch.setattr(trees, "SCORED_ROWS", 700)
    parts = [[r["tree"] for r in part.select("tree").collect()] for part in own.tables(spark)]
    assert sum(parts, []) == [-1, *range(12)] and len(parts) > 4 and max(map(len, parts)) < 12
    own.write(spark, str(tmp_path / "model"))
    again = TreeModel.from_table(spark.read.parquet(str(tmp_path / "model")))
    assert told(own) == told(again) == whole
    assert again.importances == pytest.approx(own.importances)
    assert all(len(t.value) == (t.feature < 0).sum() for t in again.trees)  # leaves alone have values


def test_trees_of_a_pass_are_bounded_by_what_they_shuffle():
    forest = [Ensemble(Squared(), Growth(15), 200, bagged=True), Ensemble(Votes(6), Growth(15), 200, bagged=True)]
    wanted = lambda i: [(i, n) for n in range(200)]
    drawn = 1 - np.exp(-1)
    for total in (10**4, 10**6, 10**7, 10**9):
        for i, columns in ((0, 1), (1, 6)):
            taken = trees._passes(wanted(i), forest, total, 6)
            most = max(trees.PASS_TABLES * total, 6 * trees.LOCAL_ROWS * trees.FOREST_FACTOR)
            assert 1 <= taken <= 200 and taken * drawn * total <= most
            assert taken * min(2 << 15, 2 * total) * columns <= trees.PASS_VALUES
    assert trees._passes(wanted(0)[:3], forest, 10**4, 6) == 3 and trees._passes(wanted(0), forest, 10**7, 6) == 6


def test_the_table_of_scores_is_written_over(signal, monkeypatch, tmp_path):
    """Boosting keeps the table as it was last written and none before."""
    from yieldengine import staging

    monkeypatch.setattr(trees, "PENDING", 2)
    monkeypatch.setattr(staging, "checkpoint_root", lambda spark: str(tmp_path))
    model = boosted(trees=9, rows=1.0)
    table, edges = grown(signal, model)
    kept = [p.name for p in tmp_path.iterdir() if list(p.glob("part-*")) and not list(p.glob("*.parquet"))]
    assert len(kept) == 1
    scored = {r["key"]: r["score_0"][0] for r in trees.scores(table, [1]).collect()}
    told = TreeModel.of(model, FEATURES, edges).transform(signal).select("key", "prediction").collect()
    assert scored == pytest.approx({r["key"]: r["prediction"] for r in told})


def test_what_the_rows_were_shuffled_by_is_removed(signal):
    env = signal.sparkSession._jvm.org.apache.spark.SparkEnv.get()
    shuffled = lambda: {b for b in env.blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    edges = trees.bin_edges(signal, FEATURES, 64)
    before = shuffled()
    table = trees.training_table(signal.repartition(7), FEATURES, edges, [91.0])
    own = shuffled() - before
    trees.train(table, [boosted(trees=1, growth=Growth(1))])
    ends = time.time() + 20
    while shuffled() & own and time.time() < ends:
        time.sleep(0.2)
    assert own and not shuffled() & own and table.rows.count()
