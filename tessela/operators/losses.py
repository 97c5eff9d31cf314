"""Losses and accuracies of scored tables, as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)) that neither overflows nor loses small values."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pairwise_losses(pairs: DataFrame, positive: str = "pos_score", negative: str = "neg_score", margin: float = 1.0) -> DataFrame:
    """One row: BPR loss, hinge loss and the share of pairs in the right order."""
    gap = F.col(positive) - F.col(negative)
    return pairs.agg(
        F.avg(_softplus(-gap)).alias("bpr_loss"),
        F.avg(F.greatest(F.lit(0.0), F.lit(margin) - gap)).alias("hinge_loss"),
        F.avg((gap > 0).cast("double")).alias("pairwise_accuracy"),
    )


def _with_maximum(lists: DataFrame, list_id: str, *columns: str) -> DataFrame:
    peaks = lists.groupBy(list_id).agg(*[F.max(c).alias(f"__max_{c}") for c in columns])
    return lists.join(peaks, list_id)


def softmax_loss(lists: DataFrame, list_id: str = "list_id", score: str = "score", label: str = "label") -> DataFrame:
    """Per list: -sum(label * log softmax(score)), from sums alone: log-sum-exp * sum(label) - sum(label * score)."""
    shifted = _with_maximum(lists, list_id, score)
    grouped = shifted.groupBy(list_id).agg(
        F.sum(F.exp(F.col(score) - F.col(f"__max_{score}"))).alias("e"), F.first(f"__max_{score}").alias("m"),
        F.sum(label).alias("labels"), F.sum(F.col(label) * F.col(score)).alias("weighted"),
    )
    return grouped.select(list_id, ((F.log("e") + F.col("m")) * F.col("labels") - F.col("weighted")).alias("loss"))


def listnet_loss(lists: DataFrame, list_id: str = "list_id", score: str = "score", label: str = "label") -> DataFrame:
    """Per list: -sum(softmax(label) * log softmax(score))."""
    shifted = _with_maximum(lists, list_id, score, label)
    target = F.exp(F.col(label) - F.col(f"__max_{label}"))
    grouped = shifted.groupBy(list_id).agg(
        F.sum(F.exp(F.col(score) - F.col(f"__max_{score}"))).alias("e"), F.first(f"__max_{score}").alias("m"),
        F.sum(target).alias("t"), F.sum(target * F.col(score)).alias("ts"),
    )
    return grouped.select(list_id, (F.log("e") + F.col("m") - F.col("ts") / F.col("t")).alias("loss"))


def mean_loss(per_list: DataFrame) -> DataFrame:
    return per_list.agg(F.avg("loss").alias("loss"))


def binary_losses(scored: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Mean binary cross-entropy with logarithms not below -100, and accuracy at 0.5."""
    y, p = F.col(label), F.col(probability)

    def safe_log(x: Column) -> Column:
        return F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(F.lit(-100.0))

    hit = (p > 0.5).cast("double") == y
    return scored.agg(
        F.avg(-(y * safe_log(p) + (1 - y) * safe_log(1 - p))).alias("bce"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def _logsumexp(scores: np.ndarray, axis: int) -> np.ndarray:
    peak = scores.max(axis=axis, keepdims=True)
    return (np.log(np.exp(scores - peak).sum(axis=axis, keepdims=True)) + peak).squeeze(axis)


def in_batch_metrics(
    pairs: DataFrame, batch: str, order: str, user_vec: str, item_vec: str,
    temperature: float = 0.07, k: int = 10, max_batch: int = 2048,
) -> DataFrame:
    """(batch, rows, loss, recall): the row i of a batch should match item i of the batch.

    Loss is the mean of row-wise and column-wise cross-entropy on the diagonal of the score matrix; recall is the share of
    rows whose own item is among their k best. A batch is one small matrix product in a task; a larger one than
    ``max_batch`` stops the job, since batch sizes are a training parameter.
    """
    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_batch:
            raise ValueError(f"a batch holds {len(pdf)} rows, more than {max_batch}")
        pdf = pdf.sort_values("o")
        raw = np.stack(pdf["u"]).astype(float) @ np.stack(pdf["v"]).astype(float).T
        logits = raw / temperature
        own = np.diag(logits)
        loss = float(((_logsumexp(logits, 1) - own).mean() + (_logsumexp(logits, 0) - own).mean()) / 2)
        own_raw = np.diag(raw)[:, None]
        better = (raw > own_raw).sum(axis=1)
        earlier = (np.tril(np.ones_like(raw), -1) * (raw == own_raw)).sum(axis=1)
        recall = float((better + earlier < k).mean())
        return pd.DataFrame({"batch": [pdf["b"].iloc[0]], "rows": [len(pdf)], "loss": [loss], "recall": [recall]})

    renamed = pairs.select(
        F.col(batch).cast("long").alias("b"), F.col(order).alias("o"), F.col(user_vec).alias("u"), F.col(item_vec).alias("v")
    )
    return renamed.groupBy("b").applyInPandas(one_batch, "batch long, rows long, loss double, recall double")
