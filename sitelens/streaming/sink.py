"""A sink that a batch can be written to twice: each batch has a folder of its own, which writing again replaces."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from ..session import shared_folder


class BatchTable:
    """Rows of a stream by batch, as Parquet under ``folder``; what a reader sees depends on ``keys`` and ``order``.

    * without keys: all rows, once each (appends)
    * keys and order: of each key the row greatest by ``order``, whatever batch it came in (upserts)
    * keys alone: of each key the rows of the last batch that has any (a key's rows replaced as a whole)

    A batch that runs again after a failure overwrites its own folder and nothing else, so every batch counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str] | None = None, order: list[str] | None = None):
        self.spark, self.folder, self.schema, self.keys, self.order = spark, folder, schema, keys, order

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self._seen(batch.withColumn("batch", F.lit(batch_id).cast("long"))).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id:012d}")

    def _seen(self, rows: DataFrame) -> DataFrame:
        """What a reader sees of ``rows`` (with their batch)."""
        if not self.keys:
            return rows
        if not self.order:
            return rows.withColumn("_last", F.max("batch").over(Window.partitionBy(*self.keys))).filter("batch = _last").drop("_last")
        others = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*self.order, "batch")).alias("_best"))
        return best.select(*[F.col(c) if c in self.keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self) -> tuple[str | None, list[str]]:
        """The newest whole snapshot, and the batches after it."""
        path, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path(self.folder))] if files.exists(path(self.folder)) else []
        whole = [n for n in names if n.startswith("upto-") and files.exists(path(f"{self.folder}/{n}/_SUCCESS"))]
        snapshot = max(whole, default=None)
        return snapshot, sorted(n for n in names if n.startswith("batch-") and (snapshot is None or n[6:] > snapshot[5:]))

    def _rows(self, names: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("batch", LongType())
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        snapshot, batches = self._parts()
        return self._seen(self._rows([snapshot, *batches] if snapshot else batches)).select([f.name for f in self.schema.fields])

    def compact(self) -> None:
        """Writes what a reader sees now as a snapshot, which takes the place of the batches before it; these go once it is whole.

        To be called between runs of the stream: the last batch must not run again afterwards.
        """
        snapshot, batches = self._parts()
        if len(batches) < 2:
            return
        old = [snapshot, *batches] if snapshot else batches
        self._seen(self._rows(old)).write.mode("overwrite").parquet(f"{self.folder}/upto-{batches[-1][6:]}")
        path, files = self._files()
        for name in old:
            files.delete(path(f"{self.folder}/{name}"), True)


def run_to_table(stream: DataFrame, folder: str, *, mode: str = "append", keys: list[str] | None = None, order: list[str] | None = None, after: Callable[[int], None] | None = None) -> BatchTable:
    """Runs a stream over what there is now into a table in ``folder``; called again, it goes on from its checkpoint.

    ``after`` is called when a batch is written and does not count as done yet.
    """
    table = BatchTable(stream.sparkSession, f"{folder}/rows", stream.schema, keys, order)

    def put(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)
        if after:
            after(batch_id)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    return table


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
