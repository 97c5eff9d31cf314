"""Retrieval and ranking models trained with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.functions.ordering import dense_numbers
from tessela.roles import Roles
from tessela.session import materialize


@dataclass
class RetrievalVectors:
    """(user, vector) and (item, vector) of one retrieval model."""

    users: DataFrame
    items: DataFrame


def fit_retrieval(
    interactions: DataFrame, roles: Roles, rank: int = 64, iterations: int = 10, reg: float = 0.05,
    alpha: float = 10.0, seed: int = 7,
) -> RetrievalVectors:
    """Two-sided vectors from implicit-feedback factorization.

    Ids of any type and size become dense integers first. Repeated interactions are summed map-side, so a hot user or item
    reaches the factorization as one row per pair.
    """
    pairs = interactions.groupBy(roles.user, roles.item).agg(F.sum(roles.signal).cast("float").alias("weight"))
    users = dense_numbers(pairs, roles.user, "u")
    items = dense_numbers(pairs, roles.item, "i")
    numbered = pairs.join(users, roles.user).join(items, roles.item).select(
        F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), "weight"
    ).persist()
    model = ALS(
        userCol="u", itemCol="i", ratingCol="weight", rank=rank, maxIter=iterations, regParam=reg, alpha=alpha,
        implicitPrefs=True, seed=seed, coldStartStrategy="drop",
    ).fit(numbered)
    numbered.unpersist()

    def named(factors: DataFrame, numbers: DataFrame, key: str, number: str) -> DataFrame:
        return numbers.join(factors, numbers[number] == factors["id"]).select(
            key, F.col("features").cast("array<double>").alias("vector"))

    return RetrievalVectors(named(model.userFactors, users, roles.user, "u"), named(model.itemFactors, items, roles.item, "i"))


def pair_differences(pairs: DataFrame, positive: str, negative: str) -> DataFrame:
    """(features, label): positive minus negative with label 1, and mirrored with label 0."""
    gap = F.zip_with(vectors.as_doubles(F.col(positive)), vectors.as_doubles(F.col(negative)), lambda a, b: a - b)
    both = F.array(
        F.struct(gap.alias("d"), F.lit(1.0).alias("label")),
        F.struct(F.transform(gap, lambda x: -x).alias("d"), F.lit(0.0).alias("label")),
    )
    return pairs.select(F.explode(both).alias("r")).select(array_to_vector("r.d").alias("features"), "r.label")


def fit_ranker(
    pairs: DataFrame, positive: str = "pos_features", negative: str = "neg_features", loss: str = "bpr",
    reg: float = 0.01, iterations: int = 50,
):
    """A linear pairwise ranker: logistic loss on score differences ("bpr") or a margin of 1 ("hinge")."""
    rows = pair_differences(pairs, positive, negative)
    if loss == "bpr":
        return LogisticRegression(fitIntercept=False, regParam=reg, maxIter=iterations).fit(rows)
    if loss == "hinge":
        return LinearSVC(fitIntercept=False, regParam=reg, maxIter=iterations).fit(rows)
    raise ValueError(f"unknown loss {loss!r}")


def linear_score(features: Column, model) -> Column:
    """Score of a linear ranker as an expression, so ranking stays in generated code."""
    return vectors.dot(features, F.lit([float(w) for w in model.coefficients.toArray()]))


class FactorizationMachine(Transformer):
    """Probabilities from an intercept, a weight for each place, and a vector for each place whose products weigh pairs of a row's places.

    The places of a row are one for each number, which counts with its value, and the hash of each category.
    """

    def __init__(self, dense: Sequence[str], categories: Sequence[str], intercept: float, linear: np.ndarray, factors: np.ndarray):
        super().__init__()
        self.dense, self.categories = list(dense), list(categories)
        self.intercept, self.linear, self.factors = intercept, linear, factors

    def weights(self) -> np.ndarray:
        return np.concatenate([[self.intercept], self.linear, self.factors.ravel()])

    def with_weights(self, w: np.ndarray) -> FactorizationMachine:
        size = len(self.linear)
        return FactorizationMachine(self.dense, self.categories, float(w[0]), w[1:1 + size], w[1 + size:].reshape(size, -1))

    def _place(self, *parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(len(self.linear))).cast("double")

    def entries(self) -> Column:
        """Value and place of each number, then the place of each category, -1 for null; a null number is 0, which adds nothing."""
        numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.dense]
        own = [self._place(F.lit(c)) for c in self.dense]
        places = [F.when(F.col(f"`{c}`").isNull(), -1.0).otherwise(self._place(F.lit(c), F.col(f"`{c}`").cast("string"))) for c in self.categories]
        return F.array(*numbers, *own, *places)

    def _parts(self, x: np.ndarray):
        n = len(self.dense)
        at = x[:, n:].astype(np.int64)
        value = np.concatenate([x[:, :n], (at[:, n:] >= 0).astype(float)], axis=1)
        at = np.maximum(at, 0)
        scaled = self.factors[at] * value[:, :, None]
        total = scaled.sum(axis=1)
        raw = self.intercept + (self.linear[at] * value).sum(axis=1) + 0.5 * ((total ** 2).sum(axis=1) - (scaled ** 2).sum(axis=(1, 2)))
        return at, value, scaled, total, 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the logistic loss, summed over the rows."""
        out, size, k = np.zeros(1 + self.linear.size + self.factors.size), *self.factors.shape
        for low in range(0, len(x), 4096):
            at, value, scaled, total, p = self._parts(x[low:low + 4096])
            turn = (p - y[low:low + 4096])[:, None] * value
            out[0] += (p - y[low:low + 4096]).sum()
            flat = at.ravel()
            out[1:1 + size] += np.bincount(flat, turn.ravel(), size)
            change = turn[:, :, None] * (total[:, None, :] - scaled)
            for f in range(k):
                out[1 + size + f::k] += np.bincount(flat, change[:, :, f].ravel(), size)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = self._parts

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(parts(np.stack(x.to_numpy()))[-1] if len(x) else [], dtype=float)

        p = probability(self.entries())
        return df.withColumn("probability", array_to_vector(F.transform(F.array(p), lambda v: F.array(1 - v, v))[0])).withColumn(
            "prediction", (F.element_at(vector_to_array("probability"), 2) > 0.5).cast("double"))


def fit_ctr(
    df: DataFrame, dense: Sequence[str], categories: Sequence[str], label: str = "label", factor_size: int = 8,
    iterations: int = 30, step: float = 0.05, seed: int = 7, hash_bits: int = 16,
) -> PipelineModel:
    """Click probability from numbers and categories with pairwise interactions: a factorization machine.

    Every (column, category) is hashed to one of 2^``hash_bits`` places, so no list of categories exists anywhere and the model
    has the same size whatever the data hold; categories that share a place share their weights. Nulls count as absent. Training is
    Adam on the logistic loss of all rows, as in Spark's ``FMClassifier``, with one pass over blocks of rows per step: a row only
    touches the weights of its own places, and a task sends one sum.
    """
    rng, size = np.random.default_rng(seed), 1 << hash_bits
    machine = FactorizationMachine(dense, categories, 0.0, np.zeros(size), rng.normal(scale=0.01, size=(size, factor_size)))
    known = F.when(F.col(label).isin(0, 1), F.col(label)).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))
    rows = _blocks(df.select(machine.entries().alias("x"), known.alias("label")))
    weights = machine.weights()
    first, second = np.zeros(len(weights)), np.zeros(len(weights))
    for i in range(1, iterations + 1):
        parts = _summed(rows, machine.gradient)
        if not len(parts):
            break
        gradient = parts[:-1] / parts[-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        moved = step * first / (1 - 0.9 ** i) / (np.sqrt(second / (1 - 0.999 ** i)) + 1e-8)
        weights = weights - moved
        machine = machine.with_weights(weights)
        if np.linalg.norm(moved) < 1e-6 * max(np.linalg.norm(weights), 1.0):
            break
    return PipelineModel([machine])


def fit_mlp(
    df: DataFrame, columns: Sequence[str], label: str = "label", hidden: Sequence[int] = (256, 128, 64),
    iterations: int = 50, seed: int = 7,
) -> PipelineModel:
    """A pointwise network scorer."""
    layers = [len(columns), *hidden, 2]
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="features"),
        MultilayerPerceptronClassifier(labelCol=label, layers=layers, maxIter=iterations, seed=seed),
    ]).fit(df)


def score(df: DataFrame, model: PipelineModel, out: str = "score") -> DataFrame:
    """Probability of the positive class for each row."""
    positive = F.element_at(vector_to_array("probability"), 2)
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], positive.alias(out))


def rank_items(scored: DataFrame, group: str, item: str, top_k: int | None = None, score_column: str = "score") -> DataFrame:
    """Items of each group by score, ties by item. With ``top_k`` the rank filter limits groups before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(score_column).desc(), item)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def tune_ranker(rows: DataFrame, regs: Sequence[float] = (0.001, 0.01, 0.1), train_ratio: float = 0.8, seed: int = 7):
    """Pick the regularization with the best area under the curve on held-out rows; the optimizer stops on 1e-4 gains."""
    estimator = LogisticRegression(fitIntercept=False, tol=1e-4)
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(regs)).build()
    return TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
        trainRatio=train_ratio, seed=seed,
    ).fit(rows)


@dataclass
class LinearRanker:
    """Coefficients of a pairwise ranker, as ``linear_score`` takes them."""

    coefficients: DenseVector


@dataclass
class Stopped:
    """The best model of a ladder, its held-out metric, (iterations, metric) of all rungs, and the iterations of all together."""

    model: LinearRanker
    metric: float
    history: list[tuple[int, float]]
    iterations: int


BLOCK_BYTES = 1 << 14  # a reader of tables holds thousands of rows at once
BATCH_BYTES = 8 << 20


def _blocks(rows: DataFrame) -> DataFrame:
    """(rows, x, y): the rows ``x`` (array of doubles) and ``label`` as arrays of at most BLOCK_BYTES, written once, so that a pass over them is numpy's."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = np.stack(batch["x"].to_numpy()).astype(float), batch["label"].to_numpy(dtype=float)
                step = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
                cuts = range(0, len(x), step)
                yield pd.DataFrame({
                    "rows": [len(y[a:a + step]) for a in cuts], "x": [x[a:a + step].tobytes() for a in cuts], "y": [y[a:a + step].tobytes() for a in cuts]})

    return materialize(rows.select("x", F.col("label").cast("double").alias("label")).mapInPandas(pack, "rows int, x binary, y binary"), "blocks")


def _summed(blocks: DataFrame, of_block) -> np.ndarray:
    """The sum over all blocks of an array ``of_block(x, y)``, followed by the number of rows: one partial sum per task, without its zeros.

    A task gets its blocks in batches of about BATCH_BYTES, each of which is one array for ``of_block``.
    """
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    together = max(1, BATCH_BYTES // BLOCK_BYTES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = 0.0, 0
        for batch in batches:
            for at in range(0, len(batch), together):
                n, x, y = (batch[c].iloc[at:at + together] for c in ("rows", "x", "y"))
                total = total + of_block(np.frombuffer(b"".join(x)).reshape(int(n.sum()), -1), np.frombuffer(b"".join(y)))
                rows += int(n.sum())
        if rows:
            sums = np.append(total, rows)
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"at": at, "part": sums[at]})

    # one row per feature; the number of rows, which comes last, is never 0
    sums = blocks.mapInPandas(partial, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(1 + max((r["at"] for r in sums), default=-1))
    for r in sums:
        out[r["at"]] = r["part"]
    return out


def _loss_gradient(blocks: DataFrame, scale: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean gradient of the logistic loss on scaled features."""
    weights = at / scale
    parts = _summed(blocks, lambda x, y: (1.0 / (1.0 + np.exp(-np.clip(x @ weights, -500, 500))) - y) @ x)
    return parts[:-1] / scale / parts[-1] if len(parts) else np.zeros(len(weights))


def fit_until_flat(rows: DataFrame, ladder: Sequence[int], patience: int = 3, min_delta: float = 1e-4, train_ratio: float = 0.8,
                   reg: float = 0.01, seed: int = 7) -> Stopped:
    """Train a pairwise ranker up to the iterations of each rung; stop once ``patience`` rungs in a row gain less than ``min_delta``.

    Every rung goes on from the coefficients of the one before, so all rungs together cost the iterations of the last. An
    iteration is one gradient of all training rows, which are packed and written once, with a step length from the change of the last two gradients. The metric is the area
    under the curve on rows held out by a hash of their features, the same for every rung.
    """
    x = vector_to_array("features")
    part = F.pmod(F.xxhash64(F.lit(seed), x), F.lit(1000))
    train = _blocks(rows.where(part < int(1000 * train_ratio)).select(x.alias("x"), "label"))
    held = materialize(rows.where(part >= int(1000 * train_ratio)).select(x.alias("x"), "label"), "held")
    squares = _summed(train, lambda x, y: (x * x).sum(axis=0))
    scale = np.sqrt([m or 1.0 for m in squares[:-1] / squares[-1:]])
    at, judge = np.zeros(len(scale)), BinaryClassificationEvaluator(rawPredictionCol="score")
    # the loss curves by at most a quarter of the squared length of a row, which is the number of scaled features on average
    step, last, done, best, history, waited = 1.0 / (0.25 * max(1, len(scale)) + reg), None, 0, None, [], 0
    for iterations in ladder:
        while done < iterations:
            gradient = _loss_gradient(train, scale, at) + reg * at
            if last is not None:
                moved, turned = at - last[0], gradient - last[1]
                if moved @ turned > 0:
                    step = float((moved @ moved) / (moved @ turned))
            last = (at, gradient)
            at, done = at - step * gradient, done + 1
        model = LinearRanker(Vectors.dense(at / scale))
        metric = judge.evaluate(held.select("label", linear_score(F.col("x"), model).alias("score")))
        history.append((iterations, metric))
        if best is None or metric > best[1] + min_delta:
            best, waited = (model, metric), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Stopped(best[0], best[1], history, done)
