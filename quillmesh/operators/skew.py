"""Joins and numbering that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut, parallelism


def salted_join(facts: DataFrame, lookup: DataFrame, on: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Joins facts to a lookup with at most one row a key, each key cut into `salts` parts.

    The rows of a hot key spread over `salts` tasks by their other columns; every lookup row is repeated `salts` times.
    Null keys match nothing (how="left" keeps their rows). Rows alike in all columns share a part.
    """
    assert how in ("inner", "left", "left_semi", "left_anti")
    rest = [c for c in facts.columns if c not in on] or facts.columns
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; they are counted, so df should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys with more than a quarter of what a task would have if rows were spread evenly; at most four a task."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") > total / (4 * parallelism(df.sparkSession))).select(key).collect()]


def spread_join(rows: DataFrame, other: DataFrame, key: str, hot: list, salts: int = 8) -> DataFrame:
    """Inner join of which the rows of the given hot keys spread over `salts` tasks; only the other side's rows of these
    keys are repeated. Null keys match nothing."""
    if not hot:
        return rows.join(other, key)
    rest = [c for c in rows.columns if c != key] or rows.columns
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*rest), F.lit(salts))).otherwise(0).cast("int"))
    copies = other.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "__salt"]).drop("__salt")


def range_rank(df: DataFrame, order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Numbers all rows 1..n in the given total order without a single-task window.

    Range partitioning on the whole order splits a hot leading value too. The ranged rows are written once (a sampled
    range split may differ when it is run again), then each row's number is its place in its partition plus the rows of
    the partitions before: one count a partition reaches the driver. The order must end in a unique column to be
    repeatable; an empty table gives an empty result.
    """
    parts = partitions or parallelism(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    place = ranged.withColumn("__id", F.monotonically_increasing_id())
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in place.groupBy(part.alias("p")).count().collect()}
    total, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (part + 1).cast("int"))
    return place.withColumn(rank, offset + row + 1).drop("__id")


def range_cumulate(df: DataFrame, order: list[str], weight: str, total: str = "cum", partitions: int | None = None) -> DataFrame:
    """Running sum of an integer weight over all rows in the given order, the row's own weight included.

    As range_rank: rows are range-partitioned and sorted, each partition sums up its rows as a stream, and adds the sum
    of the partitions before it; one sum a partition reaches the driver. The order must be unique.
    """
    parts = partitions or parallelism(df.sparkSession)
    ranged = cut(df.withColumn(weight, F.col(weight).cast("bigint")).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    sums = {r[0]: r[1] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(weight)).collect()}
    starts, so_far = [], 0
    for p in range(max(sums, default=-1) + 1):
        starts.append(so_far)
        so_far += sums.get(p, 0)
    placed = ranged.withColumn(total, F.element_at(F.lit(starts or [0]).cast("array<bigint>"), F.spark_partition_id() + 1))

    def add(batches):
        carried = 0
        for batch in batches:
            running = batch[weight].cumsum() + carried
            if len(batch):
                carried = int(running.iloc[-1])
            batch[total] = batch[total] + running
            yield batch

    return placed.mapInPandas(add, placed.schema)
