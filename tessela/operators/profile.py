"""Column and table statistics, each in one pass over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _of_type(df: DataFrame, kind: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, NumericType)


def _one_row_per_column(df: DataFrame, columns: list[str], stats: dict[str, callable]) -> DataFrame:
    """Aggregate every statistic of every column in one job, then turn the single row into one row per column."""
    aggregates = [make(_q(c)).alias(f"{i}_{stat}") for i, c in enumerate(columns) for stat, make in stats.items()]
    if not columns:
        aggregates = [F.count(F.lit(1)).alias("none")]
    wide = df.agg(*aggregates)
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{stat}").alias(stat) for stat in stats])
        for i, c in enumerate(columns)
    ]
    if not rows:
        empty = F.struct(F.lit("").alias("column"), *[F.lit(None).cast("double").alias(s) for s in stats])
        return wide.select(F.explode(F.filter(F.array(empty), lambda _: F.lit(False))).alias("r")).select("r.*")
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def catalog_of(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, column, pos, dtype), one row per column of the schema."""
    rows = [(dataset, f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "dataset string, column string, pos int, dtype string")


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: dtype, null_count, null_pct (2 decimals), unique_count (null counts as one value), num_rows."""
    def unique(c: Column) -> Column:
        if approx:
            counted = F.approx_count_distinct(c)
        else:
            counted = F.count_distinct(c)
        return counted + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))

    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stats = _one_row_per_column(
        df, df.columns,
        {
            "num_rows": lambda c: F.count(F.lit(1)),
            "null_count": lambda c: F.count_if(c.isNull()),
            "unique_count": unique,
        },
    )
    types = F.create_map(*[F.lit(part) for pair in dtypes.items() for part in pair])
    share = F.round(F.col("null_count") / F.col("num_rows") * 100, 2)
    return stats.select(
        "column", types[F.col("column")].alias("dtype"), "num_rows", "null_count",
        F.when(F.col("num_rows") > 0, share).otherwise(F.lit(0.0)).alias("null_pct"),
        F.col("unique_count").cast("long").alias("unique_count"),
    )


def numeric_stats(df: DataFrame) -> DataFrame:
    """min, max, mean and sample standard deviation per numeric column."""
    return _one_row_per_column(
        df, numeric_columns(df),
        {
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
            "mean": lambda c: F.avg(c),
            "std": lambda c: F.stddev_samp(c),
        },
    )


def string_stats(df: DataFrame) -> DataFrame:
    """Average and maximum length in characters per string column."""
    return _one_row_per_column(
        df, _of_type(df, StringType),
        {"avg_length": lambda c: F.avg(F.char_length(c)), "max_length": lambda c: F.max(F.char_length(c)).cast("long")},
    )


def boolean_stats(df: DataFrame) -> DataFrame:
    """Counts of true and false per boolean column; nulls are in neither."""
    return _one_row_per_column(
        df, _of_type(df, BooleanType),
        {"true_count": lambda c: F.count_if(c), "false_count": lambda c: F.count_if(~c)},
    )


def profile_quality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, cells, null cells, null share and duplicate rows. ``approx`` groups by a 64-bit row hash."""
    nulls = reduce(lambda a, b: a + b, [_q(c).isNull().cast("int") for c in df.columns])
    if approx:
        grouped = df.select(F.xxhash64(*[_q(c) for c in df.columns]).alias("key"), nulls.alias("nulls"))
        grouped = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("nulls").alias("null_cells"))
    else:
        grouped = df.groupBy(*[_q(c) for c in df.columns]).agg(
            F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("null_cells")
        )
    width = len(df.columns)
    totals = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("null_cells"), F.lit(0)).alias("null_cells"),
    )
    cells = F.col("num_rows") * width
    return totals.select(
        "num_rows", cells.alias("total_cells"), "null_cells",
        F.when(cells > 0, F.round(F.col("null_cells") / cells * 100, 2)).otherwise(F.lit(0.0)).alias("null_pct"),
        "duplicate_rows",
    )


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, num_rows, num_columns), one small aggregate per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(name).alias("dataset"), "num_rows", F.lit(len(df.columns)).alias("num_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def lake_summary(summaries: DataFrame) -> DataFrame:
    return summaries.agg(
        F.count(F.lit(1)).alias("total_datasets"),
        F.sum("num_rows").alias("total_rows"),
        F.sum("num_columns").cast("long").alias("total_columns"),
    )


def feature_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """dtype, nulls and distinct values of every column; min, max and mean where it is numeric."""
    numbers = numeric_stats(df).drop("std")
    # both sides have one row per column of the schema
    return profile_columns(df, approx).drop("num_rows", "null_pct").join(F.broadcast(numbers), "column", "left")
