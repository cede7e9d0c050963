"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then judge together.

The text view sees the whole text: shape statistics (shares of letter cases, digits, symbols and white space, word
lengths, repetition) and its words and word pairs, hashed. The metadata view sees language, source and length class.
Each is a logistic regression. Over ROUNDS rounds each view labels the documents without a label that it is surest of, of
those that the other view was not taught yet and in the proportion of the labels, for the other view's next fit. Both
are then calibrated on labelled documents held out, and a document's quality is the sum of the two calibrated log odds
less the prior's, which they both hold.

Views start from at most SAMPLE labelled documents (least hash of the id first). The exchange covers all documents without
a label: their features are written once, and a pass over them gives the log odds' quantiles, or the sums of a
step over what was taught. Which labels a document was taught follows from the rounds' views and thresholds, so no state
is written. All documents are scored, whole, each by itself, and the rows' other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.labelled import first_by_hash, one_label_per_id
from yieldengine.llm.textscan import SPACE, document_words, gram_hashes, utf8
from yieldengine.staging import stage

SAMPLE = 12_000
ROUNDS = 3
#: Steps of a fit to what was taught.
STEPS = 6
#: Part of the free documents that a view labels in one round, and how sure it must be.
TAUGHT, SURE = 0.2, 0.9
BUCKETS = 64
#: Numbers that words and word pairs are hashed to.
GRAMS = 128
#: Least deviation by which a number is scaled: what the labelled documents hardly show may be told apart by others.
LEAST_SCALE = 0.05

# byte classes: other symbols, small, capital, digit, white space, sentence marks, above ASCII
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[SPACE] = 4
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5
_KIND[128:] = 6
SHAPES = 11
TEXT_FEATURES = SHAPES + GRAMS


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashed words and pairs of neighbouring words, damped by logarithm and scaled to length 1."""
    both = np.concatenate([words, gram_hashes(words, 2)])
    counts = np.log1p(np.bincount((both % np.uint64(GRAMS)).astype(np.int64), minlength=GRAMS))
    return counts / max(np.sqrt(counts @ counts), 1e-12)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of shape statistics and hashed words per text; an empty or null text has all zero."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, TEXT_FEATURES))
    for i, words in enumerate(document_words(column)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            continue
        kinds = np.zeros(7)
        for x in range(a, b, 1 << 20):
            kinds += np.bincount(_KIND[data[x : min(x + (1 << 20), b)]], minlength=7)
        n, count = b - a, max(len(words), 1)
        different = len(np.unique(words)) if len(words) else 1
        repeats = float(np.mean(words[1:] == words[:-1])) if len(words) > 1 else 0.0
        letters = max(kinds[1] + kinds[2] + kinds[6], 1)
        out[i, SHAPES:] = _grams(words)
        out[i, :SHAPES] = (
            np.sqrt(kinds[2] / letters), np.sqrt(kinds[0] / n), np.sqrt(kinds[3] / n), kinds[4] / n, np.sqrt(kinds[5] / n),
            kinds[6] / n, np.log(n / count), np.sqrt(repeats), np.log(different) / np.log(count + 1),
            kinds[2] / letters, kinds[0] / n,
        )
    return out


def metadata_features(batch: pa.RecordBatch, lang: int, source: int, n_chars: int) -> np.ndarray:
    """Indicator numbers of language, source and length class, each in its own range of columns."""
    def bucket(values, base):
        return [base + (crc32(str(v).encode()) % BUCKETS if v is not None else BUCKETS) for v in values.to_pylist()]

    size = [0 if v is None or v < 0 else int(np.log2(v + 1)) + 1 for v in batch.column(n_chars).to_pylist()]
    columns = [bucket(batch.column(lang), 0), bucket(batch.column(source), BUCKETS + 1)]
    return np.array([*columns, [2 * BUCKETS + 2 + min(s, BUCKETS) for s in size]], dtype=np.int64).reshape(3, -1).T


METADATA_COLUMNS = 3 * (BUCKETS + 1)


def _indicators(numbers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(numbers), METADATA_COLUMNS))
    out[np.arange(len(numbers))[:, None], numbers] = 1
    return out


@dataclass(frozen=True)
class View:
    """Standardisation, weights and calibration (slope, offset) of one view's logistic regression."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        # statistics far outside those seen count as the edge of what was seen
        standard = np.clip((features - self.middle) / self.scale, -8, 8)
        return self.slope * (standard @ self.weights[:-1] + self.weights[-1]) + self.offset


def _newton(features: np.ndarray, labels: np.ndarray, penalty: np.ndarray, steps: int = 12) -> np.ndarray:
    weights = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        curve = features.T @ (features * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty)
        weights = weights + np.linalg.solve(curve, features.T @ (labels - p) - penalty * weights)
    return weights


def _penalty(size: int) -> np.ndarray:
    penalty = np.full(size, 1.0)
    penalty[-1] = 1e-6
    return penalty


def _newton_sums(view: View, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a step of an uncalibrated view adds up over documents: curvature and gradient.

    The curvature is its upper bound (p (1 - p) <= 1/4), so that no step overshoots.
    """
    standard = np.hstack([np.clip((features - view.middle) / view.scale, -8, 8), np.ones((len(features), 1))])
    p = 1 / (1 + np.exp(-np.clip(standard @ view.weights, -30, 30)))
    return standard.T @ standard / 4, standard.T @ (labels - p)


def _stepped(view: View, *sums: tuple[np.ndarray, np.ndarray]) -> View:
    penalty = _penalty(len(view.weights))
    curve, pull = (sum(x) for x in zip(*sums))
    step = np.linalg.solve(curve + np.diag(penalty), pull - penalty * view.weights)
    return View(view.middle, view.scale, view.weights + step)


def _fit_view(features: np.ndarray, labels: np.ndarray) -> View:
    middle, scale = features.mean(axis=0), np.maximum(features.std(axis=0), LEAST_SCALE)
    standard = np.clip((features - middle) / scale, -8, 8)
    standard = np.hstack([standard, np.ones((len(standard), 1))])
    return View(middle, scale, _newton(standard, labels, _penalty(standard.shape[1])))


def _calibrate(view: View, features: np.ndarray, labels: np.ndarray, prior: float) -> View:
    """Slope and offset that make the held-out log odds right; a view that tells nothing comes out as the prior."""
    raw = view.log_odds(features)
    slope, offset = _newton(np.stack([raw, np.ones_like(raw)], axis=1), labels, np.array([1e-2, 1e-6]))
    if not np.isfinite(slope) or slope <= 0:
        slope, offset = 0.0, prior
    return View(view.middle, view.scale, view.weights, float(slope), float(offset))


@dataclass(frozen=True)
class QualityModel:
    text: View | None
    metadata: View | None
    prior: float
    #: The views before any exchange, and for each round how many documents the text view taught the other, and was taught.
    first: tuple[View, View] | None = None
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def log_odds(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.text is None or self.metadata is None:
            return np.full(len(text), self.prior)
        shape = np.where(text.any(axis=1), self.text.log_odds(text), self.prior)  # an empty text tells nothing
        return shape + self.metadata.log_odds(_indicators(metadata)) - self.prior


@dataclass(frozen=True)
class Round:
    """The views that taught in a round, and from which log odds up a view taught good, and down to which poor."""

    text: View
    metadata: View
    by_text: tuple[float, float]
    by_metadata: tuple[float, float]


def _odds(view: tuple[View, View], text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of both views; an empty text is told nothing about."""
    return np.where(text.any(axis=1), view[0].log_odds(text), 0.0), view[1].log_odds(_indicators(metadata))


def taught(history: list[Round], text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels that the text view was taught, and the metadata view, by the rounds so far; NaN: none yet."""
    out = (np.full(len(text), np.nan), np.full(len(text), np.nan))
    for past in history:
        by_text, by_metadata = _odds((past.text, past.metadata), text, metadata)
        for label, odds, (good, poor) in ((out[1], by_text, past.by_text), (out[0], by_metadata, past.by_metadata)):
            free = np.isnan(label)
            label[free & (odds >= good)] = 1.0
            label[free & (odds <= poor)] = 0.0
    return out


VIEW_COLUMNS = ("text", "lang", "source", "n_chars")
_VIEWS = "doc_id long, text binary, metadata binary"


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = text_features(batch.column(1)), metadata_features(batch, 2, 3, 4)
        cells = [pa.array([row.tobytes() for row in part], pa.binary()) for part in (text.astype(np.float32), meta.astype(np.int16))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cells], names=["doc_id", "text", "metadata"])


def view_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of both views, packed."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"),
    )
    return given.mapInArrow(_view_rows, _VIEWS)


def _unpacked(text: list[bytes], metadata: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.frombuffer(b"".join(text), np.float32).reshape(-1, TEXT_FEATURES).astype(np.float64),
        np.frombuffer(b"".join(metadata), np.int16).reshape(-1, 3).astype(np.int64),
    )


def dense(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked([bytes(r["text"]) for r in rows], [bytes(r["metadata"]) for r in rows])


#: Rows of a batch that are unpacked at a time.
UNPACKED = 2048


def _parts(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x in range(0, batch.num_rows, UNPACKED):
        yield _unpacked(*(batch.column(first + i).slice(x, UNPACKED).to_pylist() for i in range(2)))


def _free_odds(history: list[Round], views: tuple[View, View]):
    """by_text: log odds of the text view where the metadata view was not taught; by_metadata: the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, metadata in _parts(batch, 1):
                told, odds = taught(history, text, metadata), _odds(views, text, metadata)
                columns = [pa.array(odds[i], mask=~np.isnan(told[1 - i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["by_text", "by_metadata"])

    return run


def _thresholds(pool: DataFrame, history: list[Round], views: tuple[View, View], rate: float) -> list[tuple[float, float]]:
    """For each view as teacher: the log odds of the surest TAUGHT of the free documents, in the labels' proportion."""
    ends = [1 - TAUGHT * rate, TAUGHT * (1 - rate)]
    found = pool.mapInArrow(_free_odds(history, views), "by_text double, by_metadata double").agg(
        *[F.percentile_approx(c, ends, 1000).alias(c) for c in ("by_text", "by_metadata")]
    ).first()
    least = float(np.log(SURE / (1 - SURE)))
    return [
        (max(q[0], least), min(q[1], -least)) if q else (np.inf, -np.inf) for q in (found["by_text"], found["by_metadata"])
    ]


def _taught_metadata(history: list[Round]):
    """The metadata of the documents that its view was taught, with the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, metadata in _parts(batch, 1):
                label = taught(history, text, metadata)[1]
                told = ~np.isnan(label)
                columns = [*metadata[told].T, label[told].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "source", "size", "label"])

    return run


def _partial_sums(history: list[Round], view: View):
    """A partition's share of a step of the text view, a row of the curvature each (with its gradient and count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(view.weights)
        sums = np.zeros((size, size + 2))
        for batch in batches:
            for text, metadata in _parts(batch, 1):
                label = taught(history, text, metadata)[0]
                told = ~np.isnan(label)
                if told.any():
                    curve, pull = _newton_sums(view, text[told], label[told])
                    sums[:, :size] += curve
                    sums[:, size] += pull
                    sums[:, size + 1] += told.sum()
        if sums[0, -1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())], names=["row", "sums"]
            )

    return run


def _added_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[row] = total.get(row, 0) + np.frombuffer(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["row", "sums"]
    )


def taught_sums(pool: DataFrame, history: list[Round], view: View) -> tuple[np.ndarray, np.ndarray, int]:
    """Curvature and gradient of a step of the text view over all that it was taught, and how much that is."""
    schema = "row int, sums binary"
    added = pool.mapInArrow(_partial_sums(history, view), schema).repartition("row").mapInArrow(_added_rows, schema)
    size = len(view.weights)
    sums = np.zeros((size, size + 2))
    for row in added.collect():  # as many rows as there are features
        sums[row["row"]] = np.frombuffer(row["sums"])
    return sums[:, :size], sums[:, size], int(sums[0, -1])


def co_train(text: np.ndarray, metadata: np.ndarray, labels: np.ndarray, pool: DataFrame) -> tuple[list[View], tuple[View, View], list[tuple[int, int]]]:
    """Both views after ROUNDS exchanges of confident labels over `pool`, the views before, and the numbers exchanged."""
    rate = labels.mean()
    known = (text, _indicators(metadata))
    first = views = (_fit_view(known[0], labels), _fit_view(known[1], labels))
    history: list[Round] = []
    exchanged: list[tuple[int, int]] = []
    before = (0, 0)
    for _ in range(ROUNDS):
        by_text, by_metadata = _thresholds(pool, history, views, rate)
        history.append(Round(*views, by_text, by_metadata))
        # the metadata of what its view was taught are few different rows, counted
        cells = pool.mapInArrow(_taught_metadata(history), "lang long, source long, size long, label long").groupBy(
            "lang", "source", "size").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
        taught_cells = _indicators(np.array([r[:3] for r in cells], dtype=np.int64).reshape(-1, 3))
        good, n = np.array([r["good"] for r in cells], dtype=float), np.array([r["n"] for r in cells], dtype=float)
        text_view, metadata_view, count = views[0], views[1], 0
        for _ in range(STEPS):
            curve, pull, count = taught_sums(pool, history, text_view)
            text_view = _stepped(text_view, _newton_sums(text_view, known[0], labels), (curve, pull))
            metadata_view = _stepped(
                metadata_view, _newton_sums(metadata_view, known[1], labels), _weighted_sums(metadata_view, taught_cells, good, n)
            )
        views = (text_view, metadata_view)
        exchanged.append((int(n.sum()) - before[0], count - before[1]))
        before = (int(n.sum()), count)
    return list(views), first, exchanged


def _weighted_sums(view: View, features: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_newton_sums` over rows that stand for n documents, `good` of them with label 1."""
    standard = np.hstack([np.clip((features - view.middle) / view.scale, -8, 8), np.ones((len(features), 1))])
    p = 1 / (1 + np.exp(-np.clip(standard @ view.weights, -30, 30)))
    return standard.T @ (standard * n[:, None]) / 4, standard.T @ (good - n * p)


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on a bounded sample of labelled documents and all without a label. Without labelled documents of both kinds
    every document has the same quality.

    Texts are read whole, whatever their length. Of rows that repeat a labelled doc_id one is taken; unlabelled rows
    count as often as they stand there, those without an id too.
    """
    bound_batches(docs.sparkSession)
    labels = stage(one_label_per_id(labels, "quality"), "quality-labels")
    rows = stage(view_table(docs), "quality-views")
    chosen = F.broadcast(first_by_hash(labels, SAMPLE, 7))  # of bounded size
    found = (
        rows.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "metadata")).alias("row"))
        .select("doc_id", "label", "row.*").orderBy("label", "text", "metadata").collect()
    )
    known = np.array([r["label"] for r in found], dtype=float)
    rate = known.mean() if len(known) else 1.0
    prior = float(np.log((known.sum() + 0.5) / (len(known) - known.sum() + 0.5))) if len(known) else 1.0
    if not 0 < rate < 1:
        return QualityModel(None, None, prior)
    text, metadata = dense(found)
    pool = stage(rows.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text", "metadata"), "quality-pool")
    held = np.arange(len(known)) % 4 == 0
    views, first, exchanged = co_train(text[~held], metadata[~held], known[~held], pool)
    calibrated = [
        _calibrate(f, v[held], known[held], prior) for f, v in zip(views, (text, _indicators(metadata)))
    ]
    return QualityModel(*calibrated, prior, first, exchanged)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_columns - len(VIEW_COLUMNS)
            odds = model.log_odds(text_features(batch.column(n)), metadata_features(batch, n + 1, n + 2, n + 3))
            quality = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(quality)], names=[*batch.schema.names[:n], "quality"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) of every row, with quality: the probability that the document is good.

    Null and empty texts are judged by their metadata alone, very long ones are read whole. Null metadata is a class of its own. Rows
    are independent: repeated rows give repeated results, nulls stay, a table without rows gives none. A column of
    docs named quality gives way to the result.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "quality"]
    given = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"), F.col("lang").cast("string").alias("__lang"),
        F.col("source").cast("string").alias("__source"), F.col("n_chars").cast("long").alias("__n_chars"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(_scored(shared), f"{fields}quality double")


def score_views(docs: DataFrame, views: tuple[View, View], keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with each view's own log odds, text and metadata."""
    given = docs.select(*keep, F.col("text").alias("__text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            odds = _odds(views, text_features(batch.column(n)), metadata_features(batch, n + 1, n + 2, n + 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, odds)], names=[*keep, "text", "metadata"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return given.mapInArrow(run, f"{fields}text double, metadata double")
