"""Toxicity: cumulative-link ordinal regression from sparse text features to severity grades.

Grades: 0 clean; 1, 2, 3 thirds of the labelled toxic documents by how much of what marks toxic ones they hold.
The model has P(grade <= k) = logistic(t_k - w.x) with one weight vector w for all thresholds t_0 < t_1 < t_2; a
document's expected severity is the sum of P(grade > k). Features are words of letters and the first four bytes of longer
words, damped by logarithm, kept if they clearly mark toxic documents among the labelled ones; those found in exactly the
same labelled documents (words of one text and its edited copies) are one feature.

The model is fitted on at most SAMPLE labelled documents (least hash of the id first); all documents are scored, whole,
each by itself: no shuffle, and the rows' other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.labelled import first_by_hash, one_label_per_id, sampled
from yieldengine.llm.textscan import NOT_LETTER, mix, pieces, span_hashes, utf8, word_spans
from yieldengine.staging import stage

SAMPLE = 12_000
FEATURES = 4096
GRADES = 4
#: Bytes of a word's beginning that are a feature of their own.
STEM = 4
_STEM_SALT = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64((1 << 20) - 1)


def _features(data: np.ndarray) -> np.ndarray:
    """Fingerprints of the words and word beginnings of one text (or piece), repeats included."""
    starts, ends = word_spans(data, NOT_LETTER)
    long = ends - starts > STEM
    stems = span_hashes(data, starts[long], starts[long] + STEM, lower=True)
    return np.concatenate([span_hashes(data, starts, ends, lower=True), mix(stems ^ _STEM_SALT)])


def _rows(column: pa.Array) -> Iterator[Iterator[np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield (data[x:y] for x, y in pieces(data, a, b))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for parts in _rows(batch.column(2)):
            parts = [_features(p) for p in parts]
            found.append(np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, dtype=np.int64))
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
            names=["doc_id", "label", "marks"],
        )


def _counts(data_parts, names: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """How often each named feature occurs in one text."""
    counts = np.zeros(len(names), dtype=np.int64)
    for part in data_parts:
        found = _features(part)
        found = found[maybe[found & _LOW]]
        at = np.searchsorted(names, found)
        at = at[names[np.minimum(at, len(names) - 1)] == found] if len(names) else at[:0]
        if len(at):
            counts += np.bincount(at, minlength=len(names))
    return counts


def _maybe(names: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[names & _LOW] = True
    return maybe


@dataclass(frozen=True)
class SeverityModel:
    """Feature fingerprints (sorted), their shared weights, and the ordered thresholds."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, strength: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - strength[:, None], -60, 60)))


def _fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int):
    """Maximum likelihood with a ridge penalty by adaptive gradient steps; gaps between thresholds stay positive."""
    n, levels = len(grades), GRADES - 1
    weights, first, gaps = np.zeros(n_features), 1.0, np.zeros(levels - 1)
    theta = np.concatenate([weights, [first], gaps])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 601):
        weights, first, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        strength = np.bincount(rows, weights[columns] * values, minlength=n)
        cumulative = 1 / (1 + np.exp(np.clip(strength[:, None] - thresholds[None, :], -60, 60)))
        padded = np.concatenate([np.zeros((n, 1)), cumulative, np.ones((n, 1))], axis=1)
        upper, lower = padded[np.arange(n), grades + 1], padded[np.arange(n), grades]
        likelihood = np.maximum(upper - lower, 1e-3)
        pull = np.zeros((n, levels + 2))  # derivative of the log likelihood by each threshold
        pull[np.arange(n), grades + 1] += upper * (1 - upper) / likelihood
        pull[np.arange(n), grades] -= lower * (1 - lower) / likelihood
        by_threshold = pull[:, 1:-1].sum(axis=0)
        gradient = np.concatenate([
            np.bincount(columns, (upper + lower - 1)[rows] * values, minlength=n_features) / n - 1e-5 * weights,
            [by_threshold.sum() / n],
            np.exp(gaps) * np.cumsum(by_threshold[::-1])[::-1][1:] / n,
        ])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    gaps = theta[n_features + 1 :]
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _grades(toxic: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    out = np.zeros(len(toxic), dtype=np.int64)
    at = np.flatnonzero(toxic)
    if len(at):
        order = np.argsort(evidence[at], kind="stable")
        out[at[order]] = 1 + np.arange(len(at)) * (GRADES - 1) // len(at)
    return out


def fit_severity(docs: DataFrame, labels: DataFrame) -> SeverityModel:
    """Fit on at most SAMPLE labelled documents. Without labelled documents of both kinds every document is clean.

    Texts are read whole, in pieces, whatever their length; equal texts count once. Of different texts under one doc_id the
    first in order is taken. Any share of the labelled documents may be toxic.
    """
    bound_batches(docs.sparkSession)
    empty = SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 50.0))
    chosen = first_by_hash(one_label_per_id(labels, "toxic"), SAMPLE, 2)
    rows = sampled(docs, chosen, [F.col("text")]).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    rows = stage(rows.select("doc_id", "label", "text"), "severity-sample")
    marks = stage(rows.mapInArrow(_sample_features, "doc_id long, label int, marks array<long>"), "severity-marks")
    total = marks.agg(F.count("*"), F.sum("label")).first()
    n, positive = total[0], total[1] or 0
    if not 0 < positive < n:
        return empty
    rate = positive / n
    # features at least five times as frequent among toxic documents as among others, whatever the share of toxic ones, and by more than chance
    kept = (
        marks.select("doc_id", "label", F.explode("marks").alias("mark")).groupBy("mark")
        .agg(F.count("*").alias("n"), F.sum("label").alias("toxic"), F.sum(F.hash("doc_id").cast("long")).alias("documents"))
        .groupBy("n", "toxic", "documents").agg(F.min("mark").alias("mark"))
        .withColumn("z", (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate)))
        .where((F.col("n") >= 5) & (F.col("z") > 4) & (F.col("toxic") * (n - positive) >= 5 * positive * (F.col("n") - F.col("toxic"))))
        .orderBy(F.desc("z"), "mark").limit(FEATURES).toPandas()
    )
    if kept.empty:
        return empty
    names = np.sort(kept["mark"].to_numpy(np.int64).view(np.uint64))
    found = rows.mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(names.tobytes())),
                            "label int, at array<int>, n array<int>").collect()
    lengths = [len(r["at"]) for r in found]
    row = np.repeat(np.arange(len(found)), lengths)
    columns = np.array([x for r in found for x in r["at"]], dtype=np.int64)
    times = np.array([x for r in found for x in r["n"]], dtype=float)
    toxic = np.array([r["label"] for r in found], dtype=np.int64)
    evidence = np.bincount(row, np.log1p(times), minlength=len(found))
    weights, thresholds = _fit(row, columns, np.log1p(times), _grades(toxic, evidence), len(names))
    return SeverityModel(names, weights, thresholds)


def _counted(kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.frombuffer(kept.value, dtype=np.uint64)
        maybe = _maybe(names)
        for batch in batches:
            rows = []
            for parts in _rows(batch.column(2)):
                counts = _counts(parts, names, maybe)
                at = np.flatnonzero(counts)
                rows.append((at.tolist(), counts[at].tolist()))
            at, counts = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array(at, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int32())),
            ], names=["label", "at", "n"])

    return run


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        maybe = _maybe(model.names)
        for batch in batches:
            strength = np.zeros(batch.num_rows)
            for i, parts in enumerate(_rows(batch.column(batch.num_columns - 1))):
                counts = _counts(parts, model.names, maybe)
                strength[i] = float(np.log1p(counts) @ model.weights)
            above = model.above(strength)
            columns = [*batch.columns[:-1], pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "expected_severity", "grade"])

    return run


def score_severity(docs: DataFrame, model: SeverityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) of every row, with expected_severity (0 to 3) and grade (0 clean; the
    number of thresholds that are more likely passed than not).

    Null and empty texts are clean, very long ones are read whole. Rows are independent: repeated rows give repeated results, nulls stay, a table
    without rows gives none. A column of docs named like a result gives way to it.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("expected_severity", "grade")]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(_scored(shared), f"{fields}expected_severity double, grade int")
