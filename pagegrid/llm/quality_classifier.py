"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Random Fourier features cos(Wx + b) turn a Gaussian kernel over the standardised statistics into a linear model. Each
partition sums its part of the normal equations, the driver adds these (a fixed size each) and solves. Scores are then
mapped to probabilities by pool-adjacent-violators on rows the ridge has not seen; 2 % of a sigmoid of the ridge score
is mixed in, which keeps order inside its flat stretches.

Results do not depend on how rows lie in partitions: means are sums of decimals, features are multiples of 2^-16, whose
products add up exactly in any order, and a row's score is summed term by term.

The model is fitted on at most about ``fit_rows`` labelled rows, chosen by hash. Statistics are column expressions over
whole texts; scoring is local to a row and never shuffles.

Defined results: null and empty texts have zero statistics and are scored as such; labels other than 0 and 1 and null
labels are ignored; a null id counts as held out; without training rows, or with one class only, every score is the share
of label 1 (0.5 without rows); repeated rows are scored each; columns beyond id and text are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrid.llm.language_id import held_out
from pagegrid.llm.quality_rules import with_statistics
from pagegrid.plans.lineage import cut

#: features are multiples of 1 / _GRID
_GRID = 65536.0
#: inputs of the kernel
INPUTS = ["r_symbols", "r_mean_word", "r_dup_lines", "r_repeat", "r_upper", "r_marks", "r_digits", "log_words", "log_lines"]


def inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, INPUTS): doubles, never null."""
    stats = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return stats.withColumns({"log_words": F.log1p("n_words"), "log_lines": F.log1p("n_lines")}).select("id", *[F.col(c).cast("double").alias(c) for c in INPUTS])


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


@dataclass
class Kernel:
    """Standardisation and random directions of the features."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Multiples of 2^-16 between -1 and 1, the last one 1."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        turned = np.tile(self.phase, (len(x), 1))
        for k, direction in enumerate(self.directions):  # a matrix product would round by the place of a row
            turned += z[:, k, None] * direction
        return np.column_stack([np.round(np.cos(turned) * _GRID) / _GRID, np.ones(len(x))])


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit: pooled blocks at their mean score."""
    blocks: list[list[float]] = []
    for i in np.argsort(score, kind="stable"):
        blocks.append([score[i] * weight[i], label[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s, y, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + y, blocks[-1][2] + w]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass
class Classifier:
    kernel: Kernel
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, out = self.kernel.features(x), np.zeros(len(x))
        for k, w in enumerate(self.weights):
            out += z[:, k] * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        fitted = np.interp(raw, *self.knots) if self.knots else raw
        # the raw score keeps order inside a flat stretch of the calibration
        return np.round(np.clip(0.98 * fitted + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1), 9)


def training_rows(stats: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, label_col: str, learn_from: Column | None = None) -> DataFrame:
    """(id, INPUTS, label, calibrate) for about ``fit_rows`` labelled rows at most."""
    given = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    given = given.where(~held_out(F.col("id")) if learn_from is None else learn_from)
    share = float(fit_rows) / max(given.count(), 1)
    h = F.xxhash64(F.lit(5), "id")
    chosen = given.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < share)
    return stats.join(chosen, "id").withColumn("calibrate", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(4)) == 0)


def fit(rows: DataFrame, features: int = 192, width: float = 3.0, ridge: float = 1e-3, seed: int = 11, fit_tasks: int = 16) -> Classifier | float:
    """A classifier, or one score for all where there is nothing to tell apart. ``rows`` as of ``training_rows``."""
    rows = cut(rows.drop("id").coalesce(fit_tasks))
    exact = {c: F.round(F.least(F.col(c), F.lit(1e9)), 6).cast("decimal(16,6)") for c in INPUTS}
    stat = rows.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("int")).alias("good"), *[F.sum(x * y).alias(f"{k}_{c}") for c, x in exact.items() for k, y in (("m", F.lit(1)), ("s", x))]).first()
    if not stat["n"]:
        return 0.5
    if stat["good"] in (0, stat["n"]):
        return float(stat["good"] > 0)
    random = np.random.default_rng(seed)
    mean = [stat[f"m_{c}"] / stat["n"] for c in INPUTS]
    spread = [float(max(stat[f"s_{c}"] / stat["n"] - m * m, 0)) ** 0.5 for c, m in zip(INPUTS, mean, strict=True)]
    kernel = Kernel(np.array(mean, float), np.array([s if s > 1e-5 else 1.0 for s in spread]), random.normal(size=(len(INPUTS), features)) / width, random.uniform(0, 2 * np.pi, features))

    def sums(batches):
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = kernel.features(_matrix(batch, INPUTS))
            total += np.column_stack([z.T @ z, z.T @ batch.column("label").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = np.zeros((features + 1, features + 2))
    for r in rows.where("not calibrate").mapInArrow(sums, "part binary").toLocalIterator():  # at most fit_tasks of a fixed size
        total += np.frombuffer(r["part"]).reshape(total.shape)
    # features of the kernel have length sqrt(2 / features)
    size = np.append(np.full(features, np.sqrt(2 / features)), 1.0)
    weights = size * np.linalg.solve(total[:, :-1] * np.outer(size, size) + ridge * max(total[-1, -2], 1.0) / 100 * np.eye(features + 1), total[:, -1] * size)
    model = Classifier(kernel, weights)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.raw(_matrix(batch, INPUTS)), 4)), batch.column("label")], ["raw", "label"])

    # scores of four digits: a bounded number of points
    points = rows.where("calibrate").mapInArrow(raw, "raw double, label double").groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").alias("n")).toPandas()
    if len(points):
        model.knots = isotonic(points["raw"].to_numpy(), points["label"].to_numpy(), points["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Classifier | float) -> DataFrame:
    """(id, score) for ``stats`` as of ``inputs``."""
    if isinstance(model, float):
        return stats.select("id", F.lit(model).alias("score"))

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_matrix(batch, INPUTS)))], ["id", "score"])

    return stats.mapInArrow(scores, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 60_000, threshold: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score, predicted. Learns from the labels of rows that are not held out."""
    stats = cut(inputs(docs, id_col, text_col))
    model = fit(training_rows(stats, labels, fit_rows, id_col, label_col))
    scored = score(stats, model).withColumnRenamed("id", id_col)
    return scored.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")}).select(id_col, "held_out", "score", "predicted")
