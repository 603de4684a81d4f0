"""Which chapters to fetch, as a stream: finished ones are skipped, failed ones come again, until they are given up.

Events (work_id, chapter_key, kind, at) say that a chapter was ``listed``, fetched (``done``) or not (``failed``). The
state of a chapter is whether it is done and how often it has failed; its size is fixed, so the state grows with the
chapters and not with the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts at a chapter, the first included.
ATTEMPTS = 3
KINDS = ("listed", "done", "failed")
TASK = "work_id string, chapter_key string, attempt int, status string"


def tasks(events: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(work_id, chapter_key, attempt, status) for a stream of events, to be written in append mode.

    status ``fetch`` is a task: attempt 1 when a chapter is first heard of as listed, attempt n + 1 after its n-th failure;
    ``given_up`` comes once, with the last attempt, after as many failures as attempts. Nothing follows for a chapter that
    is done or given up, however often it is listed again. Events of a chapter in one batch count by ``at`` (nulls
    first), then listed, failed, done; later batches count later. Other kinds and null keys do not count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failures, known = state.get if state.exists else (False, 0, False)
        out = []
        events = sorted((at, rank, kind) for b in batches for at, rank, kind in zip(b["at"].tolist(), b["rank"].tolist(), b["kind"].tolist()))
        for _, _, kind in events:
            if done or failures >= attempts:
                continue
            if kind == "done":
                done = True
            elif kind == "failed":
                failures += 1
                out.append((*key, min(failures + 1, attempts), "fetch" if failures < attempts else "given_up"))
            elif not known:
                out.append((*key, 1, "fetch"))
            known = True
        state.update((done, failures, known))
        yield pd.DataFrame(out, columns=["work_id", "chapter_key", "attempt", "status"])

    return _ordered(events).groupBy("work_id", "chapter_key").applyInPandasWithState(step, TASK, "done boolean, failures int, known boolean", "append", GroupStateTimeout.NoTimeout)


def _ordered(events: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in ("listed", "failed", "done")]), F.col("kind")).cast("int")
    rows = events.select(F.col("work_id").cast("string").alias("work_id"), F.col("chapter_key").cast("string").alias("chapter_key"), "kind", F.coalesce(F.col("at").cast("long"), F.lit(-(2**62))).alias("at"), rank.alias("rank"))
    return rows.where(F.col("kind").isin(*KINDS)).where("work_id is not null and chapter_key is not null")


def states(events: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(work_id, chapter_key, done, failures) after all of a batch of events; what the stream's state comes to if they arrive by ``at``."""
    rows = _ordered(events)
    when = F.struct("at", "rank")
    first_done: Column = F.min(F.when(F.col("kind") == "done", when))
    ends = rows.groupBy("work_id", "chapter_key").agg(first_done.alias("end"), F.collect_list(F.when(F.col("kind") == "failed", when)).alias("failed"))
    before = F.size(F.filter("failed", lambda w: F.col("end").isNull() | (w < F.col("end"))))
    return ends.select("work_id", "chapter_key", (F.col("end").isNotNull() & (before < attempts)).alias("done"), F.least(before, F.lit(attempts)).cast("int").alias("failures"))


def keep_tasks(events: DataFrame, folder: str, checkpoint: str, attempts: int = ATTEMPTS):
    """Start a stream that adds the tasks of its events to a folder of Parquet files, each once; it goes on behind its checkpoint."""
    return tasks(events, attempts).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
