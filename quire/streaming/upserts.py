"""Index tables kept by a stream: new records are put in by key, batch by batch, and reruns change nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.streaming.keyed import BUCKETS, KeyedTable


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all machines see: below spark.checkpoint.dir; a session in one process may do without that setting."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if base is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base or tempfile.mkdtemp(prefix='quire-stream-')}/stream-{uuid.uuid4().hex}"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed versions of an index that are kept."""
    return KeyedTable(spark, folder, []).versions()


def current(spark: SparkSession, folder: str, schema, keys: list[str]) -> DataFrame:
    """The latest committed version, empty if there is none."""
    return KeyedTable(spark, folder, keys).read(schema)


def batch_upserter(folder: str, keys: list[str], order: str, stream: str = "", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each batch of a stream into the index once, however often it runs."""

    def put(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, folder, keys, order, buckets).put(batch, number, stream)

    return put


def keep_index(source: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the upkeep of an index from a streaming source; it resumes behind what its checkpoint has seen. Streams with other checkpoints may feed one index in turn."""
    names = [c for c in source.columns if c != order] + [order]
    return source.select(*names).writeStream.foreachBatch(batch_upserter(folder, keys, order, checkpoint, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
