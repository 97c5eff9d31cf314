"""Learning from new interactions: weighted preferences, replay buffer, retraining, and folding users into a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.functions.quantiles import kth_smallest
from tessela.operators.models import RetrievalVectors
from tessela.operators.recommend import days_before
from tessela.roles import SIGNAL_WEIGHTS, Roles
from tessela.session import materialize, ship


def signal_weights(
    events: DataFrame, as_of: str, weights: tuple[tuple[str, float, float], ...] = SIGNAL_WEIGHTS
) -> DataFrame:
    """Add ``weight``: the weight of the event type times exp(-age / decay); unknown types leave.

    Rows after ``as_of`` are as fresh as a row of that moment.

    The weights are configuration and enter the plan as a literal map, so there is no join.
    """
    table = F.create_map(*[
        part for name, w, d in weights
        for part in (F.lit(name), F.struct(F.lit(float(w)).alias("w"), F.lit(float(d)).alias("d")))
    ])
    rule = table[F.col("event_type")]
    known = events.where(F.col("event_type").isin(*[w[0] for w in weights]))
    return known.withColumn("weight", rule["w"] * F.exp(-F.greatest(days_before(F.col("ts"), as_of), F.lit(0.0)) / rule["d"]))


def preference(events: DataFrame, as_of: str) -> DataFrame:
    """(user_id, item_id, preference): summed decayed weights."""
    return signal_weights(events, as_of).groupBy("user_id", "item_id").agg(F.sum("weight").alias("preference"))


def replay_buffer(
    df: DataFrame, ts: str, key: str, max_size: int = 1_000_000, sample_ratio: float = 0.2
) -> DataFrame:
    """A repeatable sample of the newest ``max_size`` rows.

    The cut-off is found by narrowing aggregates, with ties on the time decided by the key, so no task sorts the table.
    """
    n = df.count()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    newest = df
    if n > max_size:
        cutoff = kth_smallest(df, micros, n - max_size)
        ties = df.where(micros == cutoff)
        counts = df.agg(F.count_if(micros > cutoff).alias("above"), F.count_if(micros == cutoff).alias("equal")).first()
        room = max_size - counts["above"]
        if room < counts["equal"]:
            first_key = kth_smallest(ties, F.col(key), counts["equal"] - room)
            newest = df.where((micros > cutoff) | ((micros == cutoff) & (F.col(key) >= first_key)))
        else:
            newest = df.where(micros >= cutoff)
    draw = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return newest.where(F.pmod(draw, F.lit(1000)) < int(round(sample_ratio * 1000)))


def retrain(
    new: DataFrame, buffer: DataFrame, fit: Callable[[DataFrame], object], judge: Callable[[object], float],
    current: object | None = None,
) -> tuple[object, float, bool]:
    """Fit on new rows and the buffer; (model, metric, replaced). The current model stays unless the metric improves."""
    challenger = fit(new.unionByName(buffer, allowMissingColumns=True))
    reached = judge(challenger)
    if current is not None:
        before = judge(current)
        if reached <= before:
            return current, before, False
    return challenger, reached, True


FOLD_ROWS = 50_000


def _gram(items: DataFrame, rank: int) -> np.ndarray:
    """The sum of y y^T over all item vectors; rank times rank numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rank, rank))
        for batch in batches:
            if len(batch):
                y = np.stack(batch["vector"].to_numpy())
                total += y.T @ y
        yield pd.DataFrame({"at": np.arange(rank * rank), "value": total.ravel()})

    sums = items.select("vector").mapInPandas(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    gram = np.zeros(rank * rank)
    for r in sums.collect():
        gram[r["at"]] = r["value"]
    return gram.reshape(rank, rank)


def _equations(user: str, alpha: float):
    """Sorted rows (user, salt, weight, vector) to one row per user and salt: sums of a y y^T and (1 + a) y, a = alpha * |weight|."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # a user may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            y, w = np.stack(batch["vector"].to_numpy()), batch["weight"].to_numpy(dtype=float)
            key = pd.MultiIndex.from_frame(batch[[user, "__salt"]])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a = alpha * np.abs(w)
            left = np.add.reduceat((a[:, None] * y)[:, :, None] * y[:, None, :], first, axis=0)
            right = np.add.reduceat(np.where(w > 0, 1 + a, 0.0)[:, None] * y, first, axis=0)
            n = np.add.reduceat((w > 0).astype(np.int64), first)
            rows = [[*key[at], batch["__salts"].iloc[at], m, b, c] for at, m, b, c in zip(first, left, right, n, strict=True)]
            if held is not None and held[:2] == rows[0][:2]:
                rows[0][3:] = [x + z for x, z in zip(held[3:], rows[0][3:], strict=True)]
            elif held is not None:
                rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield _frame(rows, user)
        if held is not None:
            yield _frame([held], user)

    return run


def _frame(rows: list, user: str) -> pd.DataFrame:
    return pd.DataFrame({
        user: [r[0] for r in rows], "salts": [r[2] for r in rows], "m": [r[3].ravel() for r in rows], "b": [r[4] for r in rows], "n": [r[5] for r in rows],
    })


def fold_in(
    model: RetrievalVectors, interactions: DataFrame, users: DataFrame, roles: Roles, reg: float = 0.05, alpha: float = 10.0,
) -> RetrievalVectors:
    """The model with new vectors for ``users``, from all of their ``interactions``, against fixed item vectors.

    This is the user half of a factorization step: x = (Y^T Y + sum a y y^T + reg n I)^-1 sum (1 + a) y over the user's
    items, a = alpha * weight. Only rows of the given users are read into it; other users keep their vectors. Users whose
    items are all unknown to the model keep theirs too, or have none. A user of more than FOLD_ROWS pairs is summed in parts.
    """
    ship(interactions.sparkSession)
    user, item = roles.user, roles.item
    known = model.items.limit(1).collect()
    rank = len(known[0]["vector"]) if known else 0
    if not rank:
        return model
    wanted = users.select(user).where(F.col(user).isNotNull()).distinct()
    pairs = interactions.join(wanted, user, "left_semi").groupBy(user, item).agg(F.sum(roles.signal).cast("float").cast("double").alias("weight"))
    pairs = materialize(pairs.join(model.items.select(item, "vector"), item), "fold-pairs")
    salts = pairs.groupBy(user).agg(F.ceil(F.count(F.lit(1)) / FOLD_ROWS).cast("long").alias("__salts"))
    rows = pairs.join(salts, user).withColumn("__salt", F.pmod(F.xxhash64(item), F.col("__salts")))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(user, "__salt", "__salts", "weight", "vector").repartition(n, user, "__salt").sortWithinPartitions(user, "__salt")
    schema = f"{user} {pairs.schema[user].dataType.simpleString()}, salts long, m array<double>, b array<double>, n long"
    sums = materialize(rows.mapInPandas(_equations(user, alpha), schema), "fold-sums")

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({user: parts[user].iloc[:1], "salts": [1], "m": [np.sum(parts["m"].to_list(), axis=0)],
                             "b": [np.sum(parts["b"].to_list(), axis=0)], "n": [int(parts["n"].sum())]})

    gram = _gram(model.items, rank)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            left = np.stack(batch["m"].to_numpy()).reshape(-1, rank, rank) + gram
            left += reg * batch["n"].to_numpy(dtype=float)[:, None, None] * np.eye(rank)
            x = np.linalg.solve(left + 1e-12 * np.eye(rank), np.stack(batch["b"].to_numpy())[:, :, None])[:, :, 0]
            yield pd.DataFrame({user: batch[user], "vector": list(x)})

    # the parts of one user are as many as its pairs over FOLD_ROWS
    whole = sums.where("salts = 1").unionByName(sums.where("salts > 1").groupBy(user).applyInPandas(merge, schema))
    solved = materialize(whole.mapInPandas(solve, f"{user} {pairs.schema[user].dataType.simpleString()}, vector array<double>"), "folded-users")
    return RetrievalVectors(model.users.join(solved, user, "left_anti").unionByName(solved), model.items)
