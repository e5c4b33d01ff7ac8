"""RBF kernel against a bounded set of landmark rows, and the kernel classifier on top.

A full kernel matrix has one cell per pair of rows and cannot grow with the data. A kernel row
against a fixed number of landmarks can: exact kernel values, computed per row beside the data,
with no join. As features of a linear classifier they stand in for the kernel classifier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import bounded_rows
from panelwright.operators import models
from panelwright.operators.impute import SEED

SIGMA = 0.1  # fixed value: the default width


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, (group, vector): one aggregate per position, combined on the map side."""
    cells = df.select(group, F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])
    return means.groupBy(group).agg(ordered.alias(vector))


def landmark_rows(landmarks: DataFrame, key: str, vector: str, count: int) -> tuple[list, np.ndarray]:
    """Landmark keys and their matrix; ``count`` is the number of landmarks the caller made, as the k of k-means, not one that data decide."""
    rows = sorted(bounded_rows(landmarks.select(key, vector), count, "landmarks"), key=lambda r: r[key])
    return [r[key] for r in rows], np.array([r[vector] for r in rows], dtype=float)


def kernel_row(vector: str, points: np.ndarray, sigma: float = SIGMA) -> Column:
    """Array of exp(-|x - p|^2 / (2 sigma^2)), one value per landmark p, in landmark order."""

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(batch.to_numpy()).astype(float)
            cells = np.stack([np.square(x - p).sum(axis=1) for p in points], axis=1)
            yield pd.Series(list(np.exp(-cells / (2 * sigma**2))))

    return values(F.col(vector))


def rbf_against(df: DataFrame, landmarks: DataFrame, key: str, landmark_key: str, vector: str, sigma: float = SIGMA, *, count: int) -> DataFrame:
    """Long kernel rows (key, landmark_key, k): every row against each of ``count`` landmarks."""
    names, points = landmark_rows(landmarks, landmark_key, vector, count)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias(landmark_key), F.col("_k").alias("k"))
    rows = df.select(key, kernel_row(vector, points, sigma).alias("_k"))
    cells = rows.select(key, F.explode(pairs).alias("cell"))
    return cells.select(key, F.col(f"cell.{landmark_key}").alias(landmark_key), F.col("cell.k").alias("k"))


def fit_landmarks(train: DataFrame, features: Sequence[str], count: int = 50) -> np.ndarray:
    """Landmarks for scaled feature columns: k-means centres of the training rows."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_vector").transform(train).select("_vector")
    model = KMeans(featuresCol="_vector", k=count, seed=SEED).fit(rows)
    return np.array(model.clusterCenters())


def with_kernel_features(df: DataFrame, features: Sequence[str], points: np.ndarray, sigma: float = SIGMA) -> DataFrame:
    """Add one column per landmark, rbf_0, rbf_1, …"""
    rows = df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features]))
    rows = rows.withColumn("_rbf", kernel_row("_x", points, sigma))
    return rows.select(*df.columns, *[F.col("_rbf")[i].alias(f"rbf_{i}") for i in range(len(points))])


@dataclass
class KernelClassifier:
    """A fitted linear classifier on kernel features, with the landmarks and width it was fitted with."""

    model: PipelineModel
    points: np.ndarray
    features: list[str]
    sigma: float

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        return models.score(self.model, with_kernel_features(rows, self.features, self.points, self.sigma), keep)


def fit_kernel_classifier(
    train: DataFrame, features: Sequence[str], label: str, landmarks: int = 50, sigma: float = SIGMA
) -> KernelClassifier:
    points = fit_landmarks(train.where(F.col(label).isNotNull()), features, landmarks)
    names = [f"rbf_{i}" for i in range(len(points))]
    model = models.fit(with_kernel_features(train, features, points, sigma), names, label, "SVC")
    return KernelClassifier(model, points, list(features), sigma)


# --- random Fourier features ------------------------------------------------------------------


def fourier_weights(dims: int, count: int, sigma: float = SIGMA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (count x dims) and phases of the feature map, the same for one seed everywhere."""
    draw = np.random.default_rng(seed)
    return draw.normal(0, 1 / sigma, (count, dims)), draw.uniform(0, 2 * np.pi, count)


def fourier_row(vector: str | Column, dims: int, count: int, sigma: float = SIGMA, seed: int = SEED) -> Column:
    """Array of ``count`` features sqrt(2 / count) cos(w x + b), as column expressions; their dot product is close to the RBF kernel.

    A component that is null counts as 0.
    """
    frequencies, phases = fourier_weights(dims, count, sigma, seed)
    x = F.col(vector) if isinstance(vector, str) else vector
    drawn = F.arrays_zip(F.lit(frequencies.tolist()).alias("w"), F.lit(phases.tolist()).alias("b"))
    dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * F.coalesce(b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.transform(drawn, lambda d: F.lit(float(np.sqrt(2 / count))) * F.cos(dot(d["w"]) + d["b"]))


def dot_product(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def fourier_bound(count: int, pairs: int, chance: float = 1e-6) -> float:
    """Error that none of ``pairs`` kernel values exceeds, but for this chance: each of the count terms lies within 2 of 0 (Hoeffding)."""
    return float(np.sqrt(8 * np.log(2 * max(1, pairs) / chance) / count))


@dataclass
class FourierClassifier:
    """A linear classifier on random Fourier features, in place of the kernel classifier."""

    model: PipelineModel
    features: list[str]
    count: int
    sigma: float
    seed: int

    def score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        return models.score(self.model, with_fourier_features(rows, self.features, self.count, self.sigma, self.seed), keep)


def with_fourier_features(df: DataFrame, features: Sequence[str], count: int, sigma: float = SIGMA, seed: int = SEED, out: str = "fourier") -> DataFrame:
    """df with one vector column of random Fourier features of scaled feature columns."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn(out, array_to_vector(fourier_row(x, len(features), count, sigma, seed)))


def fit_fourier_classifier(train: DataFrame, features: Sequence[str], label: str, count: int = 200, sigma: float = SIGMA, seed: int = SEED) -> FourierClassifier:
    model = models.fit(with_fourier_features(train, features, count, sigma, seed), ["fourier"], label, "SVC")
    return FourierClassifier(model, list(features), count, sigma, seed)
