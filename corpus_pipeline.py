"""The corpus pipeline: toxicity, quality, near copies, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next one.
All but the last return rows of `docs` as they are. Documents rejected as toxic or poor leave, one document of each
group of near copies stays (the one with the smallest doc_id), documents with a copy of a benchmark item leave, and
the last stage adds the token ids of what is left.

A row is judged by its own text: decisions are kept by a hash of doc_id and text, so two texts under one id, and rows
without an id, fare like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldengine.llm.decontaminate import find_leaks
from yieldengine.llm.pieces import encode_pieces
from yieldengine.llm.quality import fit_quality, score_quality
from yieldengine.llm.queries import model_file
from yieldengine.llm.setjoin import jaccard_components
from yieldengine.llm.toxicity import fit_severity, score_severity
from yieldengine.staging import stage

#: Documents of less than this probability of being good are rejected.
LEAST_QUALITY = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded clean."""
    model = fit_severity(docs, _labels(spark, sf_dir))
    return score_severity(docs, model).where("grade = 0").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good rather than poor."""
    model = fit_quality(docs, _labels(spark, sf_dir))
    return score_quality(docs, model).where(F.col("quality") >= LEAST_QUALITY).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a number that tells rows of different id or text apart, nulls included."""
    return docs.withColumn("__key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, one without an id only where none has one.

    A text without words is no copy of another; of rows that repeat id and text, one stays.
    """
    keyed = _keyed(docs)
    found = stage(jaccard_components(keyed, "__key"), "near-copies").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("group"))
    # keys that leave and keys that repeat grow with the documents, so they are never broadcast
    groups = found.groupBy("__key").agg(F.min("group").alias("group"), F.count("*").alias("rows"))
    near = groups.join(groups.where("group <> __key").select("group").distinct(), "group", "left_semi")
    ids = keyed.select("__key", "doc_id").distinct()
    named = ids.join(near.hint("merge"), "__key").select("group", F.struct(F.col("doc_id").isNull(), "doc_id", "__key").alias("name"))
    first = named.groupBy("group").agg(F.min("name")["__key"].alias("__key"))
    leave = near.join(first, "__key", "left_anti").select("__key").hint("merge")
    kept = keyed.join(leave, "__key", "left_anti")
    repeated = groups.where("rows > 1").select("__key").hint("merge")
    once = kept.join(repeated, "__key", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = kept.join(repeated, "__key", "left_semi").groupBy("__key").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row"))
    return once.select(*docs.columns).unionByName(again.select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, whole or edited, of a benchmark item."""
    keyed = _keyed(docs)
    leaks = stage(find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__key"), "leaks")
    return keyed.join(leaks.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def add_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of the text, with their number."""
    encoded = encode_pieces(docs, model_file())
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_copies),
    ("benchmark_leaks", drop_leaks),
    ("pieces", add_pieces),
]

#: No SQL: the stages fit models, align words and encode; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
