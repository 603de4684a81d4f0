"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every whole text gets a 64-bit fingerprint (``fingerprint_text``).
2. Over all distinct fingerprints the joint counts of bit pairs are summed. For
   m = 2 .. radius+1 the bits are grouped so that correlated ones share a
   partition, and dynamic programming gives each partition a threshold t_i with
   sum(t_i) = radius - m + 1 (-1: not searched), least in estimated probe and
   candidate rows. Two fingerprints within ``radius`` bits agree within t_i in at
   least one partition, so nothing is lost whatever the estimates are; the
   cheapest m wins.
3. Each fingerprint probes the values within t_i of its own in each partition. First
   it is only compared with the least and the greatest fingerprint that has the value,
   one row for each probe, and the links found become provisional components: a dense
   group of near copies costs links in proportion to its size, not to its square.
4. Then an equi-join on (partition, value) finds, for each probe, the other provisional
   components that have it; a component's only member is verified by the full Hamming
   distance in the join, and the members of a larger one in a second join. So every pair
   of fingerprints in different provisional components that the partitions bring together is
   verified, and no other needs to be. Links between components join them.
5. Copies only carry the component of their fingerprint, and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import batch_of, cut, fresh, map_batches
from quire.llm.components import connected_components
from quire.llm.fingerprint_text import simhash

BITS = 64
RADIUS = 4
#: Relative cost of a shuffled probe row and of a verified candidate pair.
PROBE_COST, VERIFY_COST = 20.0, 1.0
#: Parts over which the members of one component are spread in joins.
SALTS = 16


@dataclass(frozen=True)
class Part:
    """Bit positions of a partition and its threshold; -1 leaves it unsearched."""

    bits: tuple[int, ...]
    threshold: int


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text has fingerprint zero."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")), per_batch, "doc_id long, fp long")


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all rows; only these 4096 sums reach the driver."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += x.T @ x
        yield batch_of({"counts": ([total.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))})

    sums = map_batches(distinct.select("fp"), per_batch, "counts array<long>").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n"))
    out = np.zeros(BITS * BITS)
    for row in sums.collect():
        out[row.pos] = row.n
    return out.reshape(BITS, BITS)


def group_bits(counts: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """m partitions of near equal width; greedily, each takes the bits most correlated with those it has."""
    p = np.diag(counts) / n
    cov = counts / n - np.outer(p, p)
    corr = np.abs(cov / np.sqrt(np.outer(np.maximum(p * (1 - p), 1e-9), np.maximum(p * (1 - p), 1e-9))))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = (len(left) + m - k - 1) // (m - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].mean(), -b)))
        left -= set(group)
        groups.append(tuple(sorted(group)))
    return groups


def near_share(bits: tuple[int, ...], counts: np.ndarray, n: int, t: int) -> float:
    """Estimated share of pairs within t bits in a partition: a beta-binomial with the mean and
    variance that the bit counts give the distance of two independent fingerprints."""
    if t < 0:
        return 0.0
    w = len(bits)
    joint = counts[np.ix_(bits, bits)] / n
    p = np.diag(joint)
    q = 2 * p * (1 - p)
    mean = float(q.sum())
    # P(both bits differ) = 2 (p11 p00 + p10 p01)
    p10 = p[:, None] - joint
    p01 = p[None, :] - joint
    both = 2 * (joint * (1 - p[:, None] - p[None, :] + joint) + p10 * p01)
    var = float((both - np.outer(q, q)).sum() - np.trace(both - np.outer(q, q)) + (q * (1 - q)).sum())
    mu = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / (w * mu * (1 - mu)) - 1) / max(w - 1, 1), 1e-4), 0.99)
    a, b = mu * (1 - rho) / rho, (1 - mu) * (1 - rho) / rho
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return min(1.0, sum(comb(w, k) * exp(beta(k + a, w - k + b) - beta(a, b)) for k in range(t + 1)))


def allocate(groups: list[tuple[int, ...]], counts: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds with the least estimated cost that sum to radius - m + 1, by dynamic programming."""
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        cost = {t: 0.0 if t < 0 else PROBE_COST * n * sum(comb(len(g), k) for k in range(t + 1)) + VERIFY_COST * n * n / 2 * near_share(g, counts, n, t) for t in range(-1, radius + 1)}
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in cost.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[radius - m + 1]


def plan_search(counts: np.ndarray, n: int, radius: int = RADIUS) -> list[Part]:
    """The cheapest partitioning for n fingerprints. Any plan is exact; n only moves its cost."""
    plans = []
    for m in range(2, radius + 2):
        groups = group_bits(counts, n, m)
        cost, thresholds = allocate(groups, counts, n, radius)
        plans.append((cost, m, [Part(g, t) for g, t in zip(groups, thresholds)]))
    return min(plans, key=lambda x: x[:2])[2]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _probes(part: Part) -> Column:
    flips = [sum(1 << b for b in c) for k in range(part.threshold + 1) for c in combinations(part.bits, k)]
    return F.array(*[F.lit(_signed(x)) for x in flips])


def _tries(i: int, part: Part, mask: int) -> Column:
    own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    return F.transform(_probes(part), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("key")))


def _searched(parts: list[Part]) -> list[tuple[int, Part, int]]:
    """(number, partition, mask of its bits) of the partitions with a threshold."""
    return [(i, p, sum(1 << b for b in p.bits)) for i, p in enumerate(parts) if p.threshold >= 0]


def _index(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """nodes (fp, ...) with part and key: a row for each partition."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, _, mask in _searched(parts)])
    return nodes.select("*", F.explode(keys).alias("k")).select(*nodes.columns, "k.part", "k.key")


def _probe(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """nodes (fp, ...) with part and key: a row for each value within a partition's threshold."""
    tries = F.flatten(F.array(*[_tries(i, p, mask) for i, p, mask in _searched(parts)]))
    return nodes.select("*", F.explode(tries).alias("k")).select(*nodes.columns, "k.part", "k.key")


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def seed_links(nodes: DataFrame, parts: list[Part], radius: int = RADIUS) -> DataFrame:
    """(a, b): each fingerprint of nodes (fp long) with the ends of the buckets it probes, where within radius bits."""
    ends = _index(nodes.select("fp"), parts).groupBy("part", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    met = _probe(nodes.select("fp"), parts).join(ends, ["part", "key"])
    linked = met.select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b")).where((F.col("a") != F.col("b")) & _near(F.col("a"), F.col("b"), radius))
    return linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cross_links(nodes: DataFrame, parts: list[Part], radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of different components of nodes (fp long, comp long) of which some members are within radius bits."""
    index = _index(nodes.select("fp", "comp"), parts)
    groups = index.groupBy("part", "key", F.col("comp").alias("other")).agg(F.count("*").alias("n"), F.min("fp").alias("one"))
    # either of two members finds the other, so the one of the lesser component is enough
    met = _probe(nodes.select("fp", "comp"), parts).join(groups, ["part", "key"]).where(F.col("comp") < F.col("other"))
    met = met.where((F.col("n") > 1) | _near(F.col("fp"), F.col("one"), radius))
    direct = met.where(_near(F.col("fp"), F.col("one"), radius)).select("comp", "other")
    open_ = met.where((F.col("n") > 1) & ~_near(F.col("fp"), F.col("one"), radius)).select("fp", "comp", "part", "key", "other")
    members = index.select(F.col("fp").alias("b"), F.col("comp").alias("other"), "part", "key")
    further = open_.join(members, ["part", "key", "other"]).where(_near(F.col("fp"), F.col("b"), radius)).select("comp", "other")
    return direct.union(further).select(F.col("comp").alias("a"), F.col("other").alias("b")).distinct()


def components(nodes: DataFrame, parts: list[Part], radius: int = RADIUS) -> DataFrame:
    """nodes (fp long, ...) with root: the least fingerprint reachable; null for one without links."""
    first = connected_components(seed_links(nodes, parts, radius)).select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    held = cut(nodes.select("fp").join(first, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), F.col("comp").isNotNull().alias("linked")))
    second = connected_components(cross_links(held, parts, radius)).select(F.col("node").alias("comp"), F.col("root").alias("higher"))
    # Few components are joined to others; only their members look further, spread by salt, as a component may be large.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    spread = second.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    merged = held.withColumn("salt", salt).join(spread, ["comp", "salt"], "left")
    roots = merged.select("fp", F.coalesce("higher", F.when(F.col("linked"), F.col("comp"))).alias("root"))
    return nodes.join(roots, "fp")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame | None:
    """(doc_id, fp, root, component_id) for every row of docs; root numbers a group even if its doc_ids are null. None for no rows."""
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = nodes.count()
    if n == 0:
        return None
    parts = plan_search(bit_counts(nodes), n, radius)
    named = cut(components(nodes, parts, radius))
    # A fingerprint without links is its own component. The least id of the others comes back over salts.
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = named.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("fp", "root", F.col("least").alias("component_id"))
    alone = named.where("root is null").select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    return fps.join(linked.union(alone), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of at most ``radius``
    differing bits. Null and empty texts share fingerprint zero, linked like any other;
    a null doc_id stays a row and never names a component unless all are null; repeated
    rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    found = grouped(docs, radius)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, fingerprint string, component_id long")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of near duplicates, that of its smallest doc_id, with all columns.

    Among equal doc_ids the smaller fingerprint stays, among rows equal in both one of them. Nulls and
    empty texts as in near_duplicates. Texts are shuffled once, after repeated rows are dropped where they are.
    """
    found = grouped(docs, radius)
    if found is None:
        return docs
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    fp, no_id, some_id, n = fresh(docs, "_fp", "_no_id", "_id", "_n")
    chosen = found.groupBy("root").agg(F.min(order).alias("c")).select(F.col("c.last").alias(no_id), F.coalesce("c.id", F.lit(0).cast("long")).alias(some_id), F.col("c.fp").alias(fp))
    at = docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash((t or "").encode()) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, fp])

    marked = map_batches(docs, per_batch, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    # One exchange of the texts serves both: repeated rows are dropped before it, the join finds its rows where they lie.
    key = {no_id: F.col("doc_id").isNull(), some_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))}
    names = [*key, fp]
    single = marked.withColumns(key).withColumn(n, F.row_number().over(Window.partitionBy(*names).orderBy(fp))).where(F.col(n) == 1)
    return single.join(chosen, names, "left_semi").select(*docs.columns)
