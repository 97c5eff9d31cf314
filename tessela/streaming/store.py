"""A table that a stream keeps adding to, across runs: a named folder with a checkpoint and a manifest committed per batch.

    folder/checkpoint      where the stream stands (Structured Streaming's own)
    folder/parts/...       what each batch wrote
    folder/manifest/v=N    after batch N: which parts make up the table

A batch first writes its part, then the manifest version of its number; a version counts once Spark's commit marker lies
in it. A batch that is repeated after a crash finds its version and does nothing, or writes its part anew. Readers take
the newest version, so they never see half a batch. All state is in the folder: a later run, or another driver, goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessela.session import remove_folder

COMPACT_EVERY = 16


class StreamTable:
    """``merge`` sums up parts where they are deltas (every ``compact_every`` batches in storage, always when read); without
    it the table is the union of its parts. Rows carry the number of their ``batch`` if there is no ``merge``."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] | None = None, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.merge, self.compact_every = spark, folder.rstrip("/"), merge, compact_every

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of all committed versions, ascending."""
        fs, path = self._path("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbers = sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))
        return [n for n in numbers if fs.exists(self._path(f"manifest/v={n}/_SUCCESS")[1])]

    def version(self) -> dict | None:
        """The newest version: batch, schema, base (batches that are merged, or -1) and parts, names below ``parts``."""
        found = self.versions()
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/v={found[-1]}").first()[0]) if found else None

    def _read(self, version: dict) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        if not version["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/parts/{p}" for p in version["parts"]])

    def read(self) -> DataFrame:
        """The table as of the newest version."""
        version = self.version()
        if version is None:
            raise ValueError(f"no batch has been committed in {self.folder}")
        rows = self._read(version)
        return self.merge(rows) if self.merge else rows

    def _commit(self, version: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(version),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.folder}/manifest/v={version['batch']}")

    def _write(self, rows: DataFrame, batch: int) -> None:
        last = self.version()
        if last and last["batch"] >= batch:
            return  # committed before a restart
        rows = rows if self.merge else rows.withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch}")
        parts = [*(last["parts"] if last else []), f"batch={batch}"]
        version = {"batch": batch, "base": last["base"] if last else -1, "schema": rows.schema.jsonValue(), "parts": parts}
        if self.merge and batch - version["base"] >= self.compact_every:
            merged = self.merge(self._read(version))
            merged.write.mode("overwrite").parquet(f"{self.folder}/parts/base={batch}")
            version |= {"base": batch, "parts": [f"base={batch}"], "schema": merged.schema.jsonValue()}
        self._commit(version)
        if f"batch={batch}" not in version["parts"]:
            remove_folder(self.spark, f"{self.folder}/parts/batch={batch}")  # merged before any version had it
        self._sweep()

    def _sweep(self) -> None:
        """Remove versions but the newest two, and parts that neither of these has; a reader of the one before may go on."""
        numbers = self.versions()
        old, kept = numbers[:-2], set()
        if not old:
            return
        for n in numbers[-2:]:
            kept |= set(json.loads(self.spark.read.text(f"{self.folder}/manifest/v={n}").first()[0])["parts"])
        for n in old:
            for part in json.loads(self.spark.read.text(f"{self.folder}/manifest/v={n}").first()[0])["parts"]:
                if part not in kept:
                    remove_folder(self.spark, f"{self.folder}/parts/{part}")
            remove_folder(self.spark, f"{self.folder}/manifest/v={n}")

    def run(self, stream: DataFrame, delta: Callable[[DataFrame], DataFrame] | None = None, output_mode: str = "append") -> list[dict]:
        """Process what has arrived since the last run and stop; the progress reports of this run.

        ``delta`` makes a batch's part of its rows. The first run commits an empty version, so that there is a table to read.
        """
        make = delta or (lambda rows: rows)
        if self.version() is None:
            empty = make(self.spark.createDataFrame([], stream.schema))
            empty = empty if self.merge else empty.withColumn("batch", F.lit(0).cast("long"))
            self._commit({"batch": -1, "base": -1, "schema": empty.schema.jsonValue(), "parts": []})
        query = (
            stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True).foreachBatch(lambda rows, batch: self._write(make(rows), batch)).start()
        )
        query.awaitTermination()
        return [json.loads(p.json) for p in query.recentProgress]
