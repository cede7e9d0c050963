"""Plan shape of the registered queries, and a few of them against their SQL."""

import glob
import os
import re

import pytest

from yieldengine.operators import forward, history
from yieldengine.plans.oracle import oracle_sql
from yieldengine.plans.queries import all_queries
from yieldengine.schema import ORDER
from yieldengine.staging import stage_clustered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

MODEL_QUERIES = {
    "train_forest", "train_gradient_boosting", "train_boosted_columns", "train_yield_models", "cv_scores", "cv_scores_forest", "feature_importance",
    "top_five_features", "model_predictions", "score_yield", "advanced_forward_model", "simple_forest", "simple_predictions",
    "output_classifier_topk", "output_probabilities", "classifier_importance", "classifier_metrics",
}
# queries whose result is small enough that building them at the smallest size stays quick
LAZY = [
    "yield_by_material", "input_agg", "output_agg_dominant_grade", "yield_history", "kd_distribution", "kd_lookup",
    "material_forward", "advanced_forward", "simulate_outputs_enhanced", "top_recommendation", "anomaly_orders",
    "materials_per_order", "order_yield_summary", "encode_lookup", "stratified_split", "error_histogram",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_is_covered():
    assert set(all_queries()) == set(oracle_sql()) | MODEL_QUERIES


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(all_queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)


def test_every_branch_of_the_recommendations_occurs(spark):
    """At the size that the queries are checked at: every level, strength, weight, thin-history branch and plan status."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{SF.removesuffix('0.001')}0.01/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM read_parquet('{path}')")
    told = {name: f"({oracle_sql()[name]})" for name in ("varied_confidence", "varied_recommendations", "varied_thin_history", "forward_statuses")}

    def values(name, column):
        return {x for (x,) in db.execute(f"SELECT DISTINCT {column} FROM {told[name]}").fetchall()}

    assert values("varied_confidence", "Confidence_Level") == {"HIGH", "MEDIUM", "LOW", "VERY LOW"}
    assert values("varied_confidence", "Risk_Level") == {"LOW", "MEDIUM", "HIGH", "VERY HIGH"}
    bounds = "CASE WHEN Historical_Orders >= 100 THEN 4 WHEN Historical_Orders >= 50 THEN 3 WHEN Historical_Orders >= 20 THEN 2 WHEN Historical_Orders >= 5 THEN 1 ELSE 0 END"
    assert values("varied_confidence", bounds) == {0, 1, 2, 3, 4}
    assert values("varied_confidence", "CAST(least(ceil(Yield_Std / 5), 5) AS INTEGER)") == {1, 2, 3, 4, 5}
    assert values("varied_confidence", "Historical_Orders < 70") == {True, False}
    assert values("varied_recommendations", "strength") == {"STRONG", "MODERATE", "WEAK"}
    assert values("varied_thin_history", "limited_data") == {True, False}
    assert values("forward_statuses", "status") == {"ok", "no input history", "no output history", "no output above threshold"}


def test_the_facts_are_aggregated_once_whatever_the_patterns(spark):
    """Requests that may give four filters: one grouping of the cells, by grouping sets."""
    plan = plan_of(all_queries()["kd_distribution_by_thickness"](spark, SF))
    assert plan.count("Expand") == 1 and "Union" not in plan


@pytest.fixture
def ledger_reads(spark, monkeypatch):
    """ledger_reads(name): the plan of a query, and how often it and the tables that it stages clustered read the line items."""
    def of(name):
        plans = []

        def recording(parts, *keys):
            plans.extend(plan_of(df) for df in parts.values())
            return stage_clustered(parts, *keys)

        for module in (forward, history):
            monkeypatch.setattr(module, "stage_clustered", recording)
        # requests are lists of materials, made beforehand in a planning run; the order join is what is looked at
        last = plan_of(all_queries()[name](spark, SF))
        return last, sum(len(re.findall(r"FileScan parquet.*lineitem", p)) for p in (*plans, last))

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield of
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, reads", [("yield_history", 2), ("material_forward", 2), ("advanced_forward", 3), ("kd_distribution", 2), ("kd_lookup", 4)])
def test_ledgers_are_read_once_and_meet_where_they_lie(spark, ledger_reads, name, reads):
    """One read per ledger (features and uncleaned totals are reads of their own), and no exchange for the order join."""
    plan, found = ledger_reads(name)
    assert found == reads
    if name in ("yield_history", "material_forward", "advanced_forward"):
        assert f"SortMergeJoin [{ORDER}" in plan and f"hashpartitioning({ORDER}" not in plan


def test_scan_is_pruned_and_filtered(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = plan_of(all_queries()["yield_by_material"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans
    for scan in scans:
        assert "EqualTo(l_linestatus" in scan and "Not(EqualTo(l_linenumber,7))" in scan
        schema = scan.split("ReadSchema")[1]
        assert "l_extendedprice" not in schema and "l_shipdate" not in schema and "l_tax" not in schema


@pytest.mark.parametrize("name", ["yield_by_material", "kd_distribution", "material_forward", "top_recommendation", "anomaly_orders"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        table = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    df = all_queries()[name](spark, SF)
    cursor = db.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    assert got == sorted(map(repr, cursor.fetchall()))
