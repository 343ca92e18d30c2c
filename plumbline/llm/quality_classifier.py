"""Operator 4: a kernel quality classifier on document statistics: random Fourier features, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

N_COMPONENTS = 256
RIDGE = 1e-2
THRESHOLD = 0.7
#: Labelled rows that a fit takes at most, chosen by a hash of doc_id. Every row is scored.
MAX_TRAINING_ROWS = 200_000
#: Partitions of the labelled rows; each sends its sums to the driver, n_components squared numbers a fold.
TRAINING_PARTITIONS = 8
BINS = 512
_KINDS = np.zeros(256, "u1")
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|", b"!?", b"#$%&*<>@\\^_~`{}[]=+/", b".", b",", b";:'\"()-", b" \t\r\x0b\x0c", b"\n"), 1):
    _KINDS[list(_bytes)] = _kind
_KINDS[0xC0:] = 12  # starts of other letters
N_FEATURES = 19


def statistics(text: str | None) -> np.ndarray:
    """Shape of a text as N_FEATURES finite numbers; a null text is empty. Nothing of its topic, language or source."""
    text = text or ""
    kinds = np.bincount(_KINDS[np.frombuffer(text.encode("utf-8", "replace"), "u1")], minlength=13).astype(float)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, letters, m = max(1, len(words)), max(1.0, kinds[1] + kinds[2] + kinds[12]), max(1, len(lines))
    return np.array([
        np.log1p(len(words)), np.log1p(len(lines)), len(text) / n, len({*words}) / n, min(1.0, len({*words}) / n * np.sqrt(n) / 30),
        1 - len({*lines}) / m, kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[9] / n,
        kinds[10] / n, np.log1p(len(text) / m), sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, np.log1p(max(map(len, words), default=0)), float(not words),
    ])


@dataclass
class Model:
    """What scoring needs: standardisation, the random features' directions and phases, ridge weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.empty((len(x), len(self.phases) + 1))
        out[:, :-1] = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        out[:, -1] = 1
        return out

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.features(x) @ self.weights)


def isotonic(centres: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: increasing levels at the pools' mean places."""
    pools: list[list[float]] = []
    for c, p, n in zip(centres, positives, counts, strict=True):
        if n:
            pools.append([p, n, c * n])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([x[2] / x[1] for x in pools]), np.array([(x[0] + 0.01) / (x[1] + 0.02) for x in pools])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text, modulo 4, is 2) and x; one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(flat, N_FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")
    return slim.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)


def _sums(train: DataFrame, make, size: int) -> np.ndarray:
    """Adds `make(batch)` of `size` numbers up inside each partition and then over the partitions, whose number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sum((np.frombuffer(r.sums) for r in train.mapInArrow(run, "sums binary").toLocalIterator()), np.zeros(size))


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", n_components: int = N_COMPONENTS, ridge: float = RIDGE, max_training_rows: int = MAX_TRAINING_ROWS, seed: int = 0) -> Model:
    """Fits on rows of `labels` that are not held out.

    The kernel's width is the root of the number of statistics, the median distance of standardised rows. Three folds,
    told by doc_id's crc32, are each scored by the ridge of the other two; isotonic calibration of these scores holds for
    the ridge of all. Repeated labels of a document are averaged; null labels and ids are left out; without any label
    the score is 0.5 everywhere.
    """
    own = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("y"))
    train = stats.where(~F.col("held_out") & F.col("doc_id").isNotNull()).join(own, "doc_id")
    train = train.select("y", "x", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int").alias("fold"), F.xxhash64("doc_id").alias("h"))
    train = materialize(train, "training")
    n = train.count()
    if n > max_training_rows:
        train = train.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * max_training_rows / n))
    train = materialize(train.repartition(TRAINING_PARTITIONS, "h"), "training")
    rng = np.random.default_rng(seed)
    d, p = N_FEATURES, n_components + 1
    s = _sums(train, lambda b: np.concatenate([[b.num_rows], _matrix(b).sum(0), (_matrix(b) ** 2).sum(0)]), 1 + 2 * d)
    mean = s[1 : d + 1] / max(1, s[0])
    scale = np.sqrt(np.maximum(s[d + 1 :] / max(1, s[0]) - mean**2, 1e-12))
    scale[scale < 1e-5] = 1
    model = Model(mean, scale, rng.normal(size=(d, n_components)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n_components), np.zeros(p), np.zeros(0), np.zeros(0))
    if not s[0]:
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = model.features(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        out = np.zeros((4, p, p + 1))
        for k in np.unique(fold):
            out[k, :, :p], out[k, :, p] = z[fold == k].T @ z[fold == k], z[fold == k].T @ y[fold == k]
        return out.ravel()

    sums = _sums(train, normal, 4 * p * (p + 1)).reshape(4, p, p + 1)

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:, :p] + ridge * max(1.0, a[p - 1, p - 1]) / n_components * np.diag([1.0] * n_components + [1e-6]), a[:, p])

    total = sums.sum(0)
    others = np.stack([solve(total - sums[k]) for k in range(4)])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        raw = (model.features(_matrix(batch)) * others[fold]).sum(1)
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS), np.bincount(at, raw, BINS)])

    positives, counts, raws = _sums(train, histogram, 3 * BINS).reshape(3, BINS)
    model.weights = solve(total)
    model.knots, model.levels = isotonic(raws / np.maximum(1, counts), positives, counts)
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score at `threshold` or more) of every row of `stats`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`, learned from `labels` (doc_id and `target`).

    Null and empty texts are scored like any text; repeated rows get equal scores; null ids are never held out nor
    learned from; empty tables give an empty one; other columns are not read.
    """
    stats = materialize(document_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, target), threshold)
