"""Writing feature matrices, reports and exported artifacts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(df: DataFrame, path: str, ts: str | None = None, mode: str = "overwrite") -> None:
    """Feature matrix as Parquet, one folder per day where a time column is named.

    Rows of a day are clustered so that a task writes few files; the rebalance hint lets Spark split a heavy day.
    """
    if ts is None:
        df.write.mode(mode).parquet(path)
        return
    dated = df.withColumn("event_date", F.to_date(ts))
    dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of bounded size (one row per metric or per column) as a single JSON-lines file."""
    df.coalesce(1).write.mode(mode).json(path)


def _as_array_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opening = "["
    for batch in batches:
        lines = [*batch["value"]]
        if lines:
            lines[0] = opening + lines[0]
            yield pd.DataFrame({"value": [lines[0], *["," + line for line in lines[1:]]]})
            opening = ","
    yield pd.DataFrame({"value": ["[]" if opening == "[" else "]"]})


def write_json_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array per partition and file, written line by line."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(_as_array_lines, "value string").write.mode(mode).text(path)


def export(
    tables: Mapping[str, DataFrame],
    models: Mapping[str, MLWritable],
    folder: str,
    include: Iterable[str] = ("tables", "models"),
) -> dict[str, str]:
    """Copy the chosen kinds of artifacts below ``folder``; returns name to path."""
    kinds = set(include)
    unknown = kinds - {"tables", "models", "indices", "config"}
    if unknown:
        raise ValueError(f"unknown artifact kinds: {sorted(unknown)}")
    base = folder.rstrip("/")
    written = {}
    for name, table in tables.items():
        kind = name.split("/", 1)[0] if "/" in name else "tables"
        if kind in kinds:
            path = f"{base}/{name}" if "/" in name else f"{base}/tables/{name}"
            table.write.mode("overwrite").parquet(path)
            written[name] = path
    if "models" in kinds:
        for name, model in models.items():
            path = f"{base}/models/{name}"
            model.write().overwrite().save(path)
            written[name] = path
    return written
