"""Running sums and maxima along an order within groups, also where one group holds most rows.

A window sorts a whole group in one task. A group of more than GROUP_ROWS rows is therefore dealt by ranges of
its order: each range runs on its own from the total of the ranges before it, so a hot group spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.scratch import once

#: Rows that one task sorts of a group.
GROUP_ROWS = 1_000_000


def total(how: str, c: Column | str) -> Column:
    return {"sum": F.sum, "max": F.max}[how](c)


def joined(how: str, a: Column, b: Column) -> Column:
    """Two totals in one; null stands for no value."""
    return F.coalesce(a + b, a, b) if how == "sum" else F.greatest(a, b)


def running(df: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, Column]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with a column for each of values (name -> ("sum" or "max", expression)): the total of its group's rows up to and with its own.

    Rows that tie in ``order`` count in any order, so it should be total. Null groups are groups. Leave texts out of df: its rows
    are dealt as they are. Structs can be maximised.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_rows:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: total(how, c).over(w) for name, (how, c) in values.items()})
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // group_rows))
    kept = df.withColumns({f"_v_{name}": c for name, (_, c) in values.items()})
    ranged = once(kept.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_part").agg(*[total(how, f"_v_{name}").alias(f"_t_{name}") for name, (how, _) in values.items()])
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_p"), *[total(how, f"_t_{name}").over(before).alias(f"_b_{name}") for name, (how, _) in values.items()])
    same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(sums[f"_k_{c}"]) for c in by], ranged["_part"] == sums["_p"])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(sums, same).withColumns({name: joined(how, F.col(f"_b_{name}"), total(how, f"_v_{name}").over(inside)) for name, (how, _) in values.items()})
    return out.select(*df.columns, *[name for name in values if name not in df.columns])
