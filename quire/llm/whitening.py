"""Whitening of embeddings by their principal components.

Entries become integers (floor(64 c) + 1,000,000), so sums over them are exact. One
pass finds the length of the vectors and the range of their entries, one their number
and sums. Then Spark SQL expressions, one for each pair of dimensions of the upper
triangle, sum centred products in one aggregation. Only these sums reach the
driver, which puts the covariance together and decomposes it with LAPACK. Vectors are
centred and projected in batches where they lie. The same aggregation over the whitened
entries measures how far their covariance is from the identity.

Vectors of more than TILE dimensions have too many pairs for one plan: the triangle is then
cut into tiles, each one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Dimensions on either side of one aggregation.
TILE = 96
#: Entries from here on do not fit the integers.
_MOST = 2.0**56


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector and entries are neither null nor NaN nor beyond 2^56."""
    entries = F.transform("embedding", lambda e: e.cast("double"))
    odd = F.exists("c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= _MOST))
    clean = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & ~odd)
    return clean.select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


def _entry(name: str, k: int) -> str:
    return f"{name}[{k}]"


def centred_products(rows: DataFrame, name: str, centres: list[str]) -> np.ndarray:
    """Sums over all rows of (v[i] - centre i) * (v[j] - centre j) for the array column ``name``, as a symmetric matrix.

    ``centres`` are SQL literals. One aggregation with a sum for each pair i <= j, or one for each tile of the triangle.
    """
    d, out = len(centres), np.zeros((len(centres), len(centres)))
    centred = [f"({_entry(name, k)} - {c})" for k, c in enumerate(centres)]
    for a in range(0, d, TILE):
        for b in range(a, d, TILE):
            pairs = [(i, j) for i in range(a, min(a + TILE, d)) for j in range(max(b, i), min(b + TILE, d))]
            used = sorted({k for pair in pairs for k in pair})
            # entries are never null, and saying so makes each of the sums cheaper
            flat = rows.select(*[F.expr(f"nvl(cast({centred[k]} as double), 0D)").alias(f"c{k}") for k in used])
            sums = flat.agg(*[F.expr(f"sum(c{i} * c{j})").alias(f"p{i}_{j}") for i, j in pairs]).first()
            for (i, j), s in zip(pairs, sums):
                out[i, j] = out[j, i] = s or 0.0
    return out


def components_of(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue; those without variance are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    kept = values > len(covariance) * np.finfo(float).eps * max(np.trace(covariance), 0.0)
    return values[kept], vectors[:, kept]


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every whole vector and component up to ``most``.

    Rows of embeddings (vec_id, embedding, ...) whose vector is null or holds null, NaN, infinite entries or such of 2^56
    and more are left out, and so are vectors of another length than most have (the longer of equally frequent ones). The
    others are the fit list. Components without variance, such as those of equal vectors, do not exist, so an empty table
    or one vector gives no rows. deviation is exact where it fits a long, else null. A null vec_id stays, repeated rows
    count each time and stay repeated, other columns are ignored.
    """
    spark = embeddings.sparkSession
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    x = integers(embeddings)
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).where("d > 0")
    most_common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most_common is None:
        return nothing
    d, n, low, high = most_common
    x = x.where(F.size("x") == d)
    # whether n * x, the sums and the deviation fit a long
    exact = n * max(abs(low), abs(high)) < 2**63 and d * (n * (high - low)) ** 2 < 2**63
    whole = "bigint" if exact else "decimal(38,0)"
    sums = [int(s) for s in x.agg(*[F.expr(f"sum(cast({_entry('x', k)} as {whole}))") for k in range(d)]).first()]
    # n * x - S is a whole number: dividing it by n is the one rounding of a centred entry
    about = [f"{s}L" if exact else f"cast('{s}' as decimal(38,0))" for s in sums]
    scaled = x.select("vec_id", F.expr("transform(x, (e, k) -> " + (f"{n}L * e" if exact else f"cast(e as decimal(38,0)) * {n}") + f" - array({', '.join(about)})[k])").alias("y"))
    covariance = centred_products(scaled.select(F.transform("y", lambda e: e.cast("double") / n).alias("y")), "y", ["0D"] * d) / n
    values, vectors = components_of(covariance, most)
    if not len(values):
        return nothing
    white = _projected(scaled, n, vectors / np.sqrt(values))
    centres = white.agg(*[F.expr(f"avg({_entry('w', k)})") for k in range(len(values))]).first()
    error = float(np.abs(centred_products(white, "w", [f"{float(c)!r}D" for c in centres]) / n - np.eye(len(values))).max())
    share = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    rows = white.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def squared(y: Column) -> Column:
    """Sum of the squares of an array of whole numbers as a long; null where it does not fit."""
    return F.aggregate(y, F.lit(0).cast("long"), lambda s, e: s + e * e)


def _projected(scaled: DataFrame, n: int, axes: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): each vector of scaled (vec_id, y), n times its centred entries, on the axes, in numpy by batches."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for b in batches:
            entries = b.column(2).flatten()
            y = (entries if entries.type == pa.int64() else entries.cast(pa.float64())).to_numpy(zero_copy_only=False).reshape(b.num_rows, len(axes))
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * k, k, dtype=np.int32)), pa.array(((y / n) @ axes).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), w], names=["vec_id", "deviation", "w"])

    whole = scaled.schema["y"].dataType.elementType.simpleString()
    if whole == "bigint":
        deviation = squared(F.col("y"))
    else:
        big = F.aggregate("y", F.lit(0).cast("decimal(38,0)"), lambda s, e: F.try_add(s, F.try_multiply(e, e)).cast("decimal(38,0)"))
        deviation = big.try_cast("long")
    return map_batches(scaled.select("vec_id", deviation.alias("deviation"), "y"), per_batch, "vec_id long, deviation long, w array<double>")
