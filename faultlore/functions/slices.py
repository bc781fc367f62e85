"""Order large groups without a task per group.

A group with more than its share of all rows is cut into slices, ranges of its order
that hold about as many rows each; all other groups are one slice.  Windows then
run within (key, slice), and what a slice needs from those before it is one value
per slice, a table of at most twice as many rows as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
#: Sampled rows for each slice.
SAMPLED = 64


class Slices:
    """Ranges of ``order`` for the groups of ``key`` in ``df`` that have more than 1 / ``slices`` of all rows.

    There are fewer such groups than slices, and about ``SAMPLED`` rows for each slice
    are sampled from them, so what comes to the driver is bounded whatever the data.
    """

    def __init__(self, df: DataFrame, key: str, order: list[Column], slices: int | None = None):
        self.key, self.order = key, F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
        spark = df.sparkSession
        slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
        counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        large = [r[0] for r in counts.filter(F.col("_n") > max(1, total // slices)).select(key).collect()] if total > slices else []
        self.bounds = None
        if large:
            share = min(1.0, SAMPLED * slices / total)
            rows = (df.filter(F.col(key).isin(large)).select(key, self.order.alias("_at"))
                    .filter(F.rand(7) < share))
            picked: dict = {}
            for row in sorted(rows.collect(), key=lambda r: tuple((v is not None, v) for v in r["_at"])):
                picked.setdefault(row[key], []).append(row["_at"])
            # every so many rows of the sample begin a slice
            step = max(1, int(total * share / slices))
            kept = [(k, sorted(set(at[step::step]), key=lambda a: tuple((v is not None, v) for v in a))) for k, at in picked.items()]
            at_type = rows.schema["_at"].dataType.simpleString()
            self.bounds = spark.createDataFrame([(k, b) for k, b in kept if b],
                                                f"`{key}` {df.schema[key].dataType.simpleString()}, _bounds array<{at_type}>")

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` with the slice of each row."""
        if self.bounds is None:
            return df.withColumn(SLICE, F.lit(0))
        of = F.size(F.filter("_bounds", lambda b: b <= self.order))
        return df.join(F.broadcast(self.bounds), self.key, "left").withColumn(
            SLICE, F.when(F.col("_bounds").isNull(), 0).otherwise(of)).drop("_bounds")

    def cut_only(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose groups have several slices, with the slice."""
        if self.bounds is None:
            return df.filter("false").withColumn(SLICE, F.lit(0))
        return df.join(F.broadcast(self.bounds), self.key).withColumn(
            SLICE, F.size(F.filter("_bounds", lambda b: b <= self.order))).drop("_bounds")

    def with_carry(self, df: DataFrame, per_slice: DataFrame, **carried: Column) -> DataFrame:
        """``df``, which has slices, with a value over all slices before: ``carried`` are aggregates of ``per_slice``.

        ``per_slice`` has one row per key and slice.  Where nothing comes before, the value is null.
        """
        if self.bounds is None:
            types = per_slice.groupBy(self.key).agg(*(c.alias(n) for n, c in carried.items())).schema
            return df.withColumns({n: F.lit(None).cast(types[n].dataType) for n in carried})
        before = Window.partitionBy(self.key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = per_slice.select(self.key, SLICE, *(c.over(before).alias(n) for n, c in carried.items()))
        return df.join(F.broadcast(carry), [self.key, SLICE], "left")
