"""Packing by length: optimal length buckets from the global histogram, token-budget batches inside each bucket.

The histogram is one combined aggregate. Dynamic programming over it picks the bucket ceilings with the least padding.
Inside a bucket, documents get dense positions without a hot window: they are ranked in hashed parts of bounded size, and
a small table of part counts gives the offsets. Position div capacity is the batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import stage, table, word_count
from tessela.llm.registry import query

BUCKETS = 16
BUDGET = 65_536
EXACT_LENGTHS = 8_192
STEPS = 1_024
PART_ROWS = 50_000


def grid(length: Column) -> Column:
    """Lengths above EXACT_LENGTHS rounded up to a grid of STEPS values per doubling, so that the histogram is bounded.

    This pads such a document by less than a part in STEPS.
    """
    doubling = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    width = F.greatest(F.lit(1), F.pow(F.lit(2.0), doubling) / STEPS).cast("long")
    return F.when(length <= EXACT_LENGTHS, length).otherwise(F.ceil(length / width) * width).cast("long")


def best_ceilings(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` bucket ceilings that minimise the summed padding of ``counts`` documents of ``lengths``.

    cost(i, j) = length[j-1] * documents(i..j) - tokens(i..j). The best split point never moves back as j grows, so every
    layer is solved by halving: O(buckets * n log n).
    """
    n = len(lengths)
    if not n:
        return []
    docs = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    splits = []
    for _ in range(min(buckets, n)):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        jobs = [(1, n, 0, n - 1)]
        while jobs:
            lo, hi, a, b = jobs.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
            k = int(cost.argmin())
            now[j], split[j] = cost[k], i[k]
            jobs += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        # a layer may also use fewer buckets
        now[0] = 0
        splits.append(split)
        best = now
    ceilings, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        ceilings.append(int(lengths[j - 1]))
        j = int(split[j])
    return sorted(ceilings)


def pack(df: DataFrame, length: Column, order: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Add n_tokens, bucket, bucket_len, batch_id (inside the bucket), slot (inside the batch) and padding.

    A batch holds ``max(1, budget // bucket_len)`` documents padded to ``bucket_len``; only a document longer than the
    budget exceeds it, alone. Documents of length 0 (null or empty texts) share the batches of the first bucket. Rows of
    equal id are all packed. Columns of these names are replaced. An empty table gives an empty table.
    """
    df = df.drop("n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")
    rows = stage(df.withColumn("n_tokens", F.coalesce(length.cast("long"), F.lit(0).cast("long"))), "pack-lengths")
    histogram = rows.groupBy(grid(F.col("n_tokens")).alias("g")).count().orderBy("g").toPandas()
    ceilings = best_ceilings(histogram["g"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets) or [0]
    g = grid(F.col("n_tokens"))
    bucket, ceiling = F.lit(len(ceilings) - 1), F.lit(ceilings[-1])
    for k in range(len(ceilings) - 2, -1, -1):
        bucket, ceiling = F.when(g <= ceilings[k], k).otherwise(bucket), F.when(g <= ceilings[k], ceilings[k]).otherwise(ceiling)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", ceiling.cast("long"))
    total = int(histogram["count"].sum())
    part = F.pmod(F.xxhash64(F.lit("pack"), F.col(order), F.col("n_tokens")), F.lit(max(1, -(-total // PART_ROWS)))).alias("__part")
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy("bucket", "__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per bucket and part: the table of part sizes, not the rows
    before = Window.partitionBy("bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("bucket", "__part").orderBy(F.col("n_tokens").desc(), F.col(order))
    at = F.col("__offset") + F.row_number().over(inside) - 1
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        rows.join(offsets, ["bucket", "__part"]).withColumn("__at", at)
        .select(*[rows[c] for c in df.columns], "n_tokens", "bucket", "bucket_len",
                F.floor(F.col("__at") / capacity).cast("long").alias("batch_id"), (F.col("__at") % capacity).cast("long").alias("slot"),
                (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    )


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack(documents.select("doc_id", word_count(F.col("text")).alias("words")), F.col("words")).drop("words")
