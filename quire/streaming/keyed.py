"""A table of keyed rows that takes batches at a cost in proportion to the batch, not to the table.

Keys are hashed into buckets. A bucket is a list of parts, oldest first, each at least twice as
large as the next: a batch adds a part to every bucket it touches, and folds into it
the newest parts that are no more than twice its size, so a row is written again about as often
as its bucket has doubled, and a bucket has a logarithm of parts. A manifest, committed by one
rename, names the parts of a version; what it does not name does not exist. It also holds the last batch of
each stream, so a batch that runs again changes nothing, and one that dies midway leaves the last version.
Parts that no kept version names are deleted after a commit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.sources.store import Store

BUCKETS = 64
#: Versions that can be read: the current one and those before it.
KEPT = 2
#: A part is folded into a new one of at least this share of its rows.
FOLD = 0.5


@dataclass
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    schema: str = ""
    #: bucket -> [(folder below data, rows)], oldest first
    parts: dict[int, list[tuple[str, int]]] = field(default_factory=dict)
    #: stream -> its last batch
    applied: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "schema": self.schema, "parts": self.parts, "applied": self.applied})

    @classmethod
    def of(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(x["version"], x["buckets"], x["schema"], {int(b): [(p, n) for p, n in held] for b, held in x["parts"].items()}, x["applied"])


class KeyedTable:
    """Rows by key in a folder of any shared file system. ``order`` settles repeated keys within a batch: the greatest wins, nulls last,
    equal ones by all values; a later batch wins over an earlier one. Null keys are keys."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.store, self.keys, self.order, self._buckets = spark, Store(spark, folder), keys, order, buckets

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The current manifest or that of a kept version; an empty one if there is none yet."""
        found = self.versions()
        if version is None and not found:
            return Manifest(buckets=self._buckets)
        return Manifest.of(self.store.read(f"manifest/{(found[-1] if version is None else version):020d}.json"))

    def read(self, schema: T.StructType | str | None = None, version: int | None = None, where: dict | None = None) -> DataFrame:
        """The rows of a version; ``where`` (every key: value) reads only the bucket of one key."""
        m = self.manifest(version)
        if not m.version:
            return self.spark.createDataFrame([], schema or "none string")
        kind = T.StructType.fromJson(json.loads(m.schema))
        wanted = m.parts
        if where is not None:
            row = self.spark.createDataFrame([tuple(where[k] for k in self.keys)], T.StructType([kind[k] for k in self.keys]))
            held = row.select(self._bucket(m.buckets)).first()[0]
            wanted = {held: m.parts.get(held, [])}
        rows = self._rows([(b, p) for b, parts in wanted.items() for p, _ in parts], kind)
        if where is not None:
            for k in self.keys:
                rows = rows.where(F.col(k).eqNullSafe(F.lit(where[k])))
        return self._latest(rows, kind).select(*kind.names)

    def put(self, batch: DataFrame, number: int, stream: str = "") -> bool:
        """Put the rows of a batch in as a new version; False if the stream's batch is in already."""
        m = self.manifest()
        if m.applied.get(stream, -1) >= number:
            return False
        kind = T.StructType.fromJson(json.loads(m.schema)) if m.version else batch.schema
        names = kind.names
        if {"_bucket", "_version", "_n"} & {c.lower() for c in names}:
            raise ValueError("a table has columns _bucket, _version and _n of its own")
        order = [F.col(self.order).desc_nulls_last()] if self.order else []
        one = Window.partitionBy("_bucket", *self.keys).orderBy(*order, *[F.col(c).desc_nulls_last() for c in names if c not in self.keys and c != self.order and _orderable(kind[c].dataType)])
        new = batch.select(*[F.col(c).cast(kind[c].dataType).alias(c) for c in names]).withColumn("_bucket", self._bucket(m.buckets))
        new = new.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").withColumn("_version", F.lit(m.version + 1).cast("long")).persist()
        try:
            sizes = {r["_bucket"]: r.n for r in new.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
            folded = {b: self._folded(m.parts.get(b, []), n) for b, n in sizes.items()}
            at = f"{m.version + 1:020d}-{uuid.uuid4().hex}"
            if sizes:
                again = [(b, p) for b, parts in folded.items() for p, _ in parts]
                rows = self._latest(self._rows(again, kind).unionByName(new), kind) if again else new
                rows.repartition("_bucket").sortWithinPartitions(*[k for k in self.keys if _orderable(kind[k].dataType)]).write.partitionBy("_bucket").parquet(self.store.at(f"data/{at}"))
        finally:
            new.unpersist()
        parts = dict(m.parts)
        for b, n in sizes.items():
            parts[b] = [*parts.get(b, [])[: len(parts.get(b, [])) - len(folded[b])], (f"{at}/_bucket={b}", n + sum(x for _, x in folded[b]))]
        done = Manifest(m.version + 1, m.buckets, kind.json(), parts, m.applied | {stream: number})
        if not self.store.commit(f"manifest/{done.version:020d}.json", done.text()):
            raise RuntimeError(f"version {done.version} was committed by another writer")
        self.prune()
        return True

    def prune(self, kept: int = KEPT) -> None:
        """Delete manifests before the last ``kept`` and the parts that no manifest names."""
        found = self.versions()
        for v in found[:-kept]:
            self.store.delete(f"manifest/{v:020d}.json")
        named = {p for v in found[-kept:] for parts in self.manifest(v).parts.values() for p, _ in parts}
        for folder in self.store.names("data"):
            inside = {f"{folder}/{b}" for b in self.store.names(f"data/{folder}") if b.startswith("_bucket=")}
            if not inside & named:
                self.store.delete(f"data/{folder}")
            else:
                for gone in inside - named:
                    self.store.delete(f"data/{gone}")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int").alias("_bucket")

    @staticmethod
    def _folded(parts: list[tuple[str, int]], rows: int) -> list[tuple[str, int]]:
        """The newest parts that a new one of so many rows takes in."""
        at = len(parts)
        while at and parts[at - 1][1] * FOLD <= rows:
            at -= 1
            rows += parts[at][1]
        return parts[at:]

    def _rows(self, parts: list[tuple[int, str]], kind: T.StructType) -> DataFrame:
        """The rows of parts with _bucket and _version."""
        by_bucket: dict[int, list[str]] = {}
        for b, p in parts:
            by_bucket.setdefault(b, []).append(self.store.at(f"data/{p}"))
        held = T.StructType([*kind.fields, T.StructField("_version", T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], held).withColumn("_bucket", F.lit(0))
        rows = self.spark.read.schema(held).parquet(*[p for b in sorted(by_bucket) for p in by_bucket[b]])
        return rows.withColumn("_bucket", F.regexp_extract(F.input_file_name(), r"/_bucket=(\d+)/", 1).cast("int"))

    def _latest(self, rows: DataFrame, kind: T.StructType) -> DataFrame:
        """Of rows with one key that of the last version; combined before the shuffle."""
        values = [c for c in kind.names if c not in self.keys]
        last = rows.groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*values, "_version"), "_version").alias("_v"))
        return last.select("_bucket", *self.keys, *[F.col(f"_v.{c}").alias(c) for c in [*values, "_version"]]).select(*kind.names, "_bucket", "_version")


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))
