"""Contracts on tables: keys, references, schemas, ids, inventories and the record of what each step did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.cleaning import audit, union_all


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and has no parent."""
    known = parent.select(F.col(parent_key).alias("__k")).distinct()
    return child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__k"), "left_anti")


def distinct_shapes(shapes: DataFrame, ring: str, key: str, grid: float = 0.001) -> DataFrame:
    """One row, the least key, of each set of equal rings: start and direction of a ring don't count."""
    points = F.transform(ring, lambda p: F.struct(F.round(p["x"] / grid).cast("long").alias("x"), F.round(p["y"] / grid).cast("long").alias("y")))
    first = F.array_position(points, F.array_min(points)).cast("int")
    turned = F.concat(F.slice(points, first, F.size(points)), F.slice(points, F.lit(1), first - 1))
    back = F.concat(F.slice(turned, 1, 1), F.reverse(F.slice(turned, F.lit(2), F.size(turned))))
    keyed = shapes.withColumn("__shape", F.least(turned, back))
    best = keyed.groupBy("__shape").agg(F.min(key).alias(key), F.count("*").alias("copies"))
    return shapes.join(best.select(key, "copies"), key)


def surrogate_ids(df: DataFrame, order: list[Column], prefix: str, width: int) -> DataFrame:
    """df with id: prefix and a running number in the given order.

    Rows are range-partitioned by the order; a number is the partition's start plus the place inside it, so
    no task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    inside = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__m"))
    starts = sizes.select("__part", F.coalesce(F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    number = (F.col("__start") + F.col("__n")).cast("string")
    return inside.join(F.broadcast(starts), "__part").withColumn("id", F.concat(F.lit(prefix), F.lpad(number, width, "0"))).drop("__part", "__n", "__start")


def missing_columns(df: DataFrame, required: dict[str, str]) -> list[str]:
    """What of required (name: type) df lacks, with the type it has instead."""
    held = dict(df.dtypes)
    return [f"{c}: {held.get(c, 'missing')} instead of {t}" for c, t in required.items() if held.get(c) != t]


def inventory(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, n_rows, n_columns of each table."""
    return union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows", F.lit(len(df.columns)).alias("n_columns")) for name, df in layers.items()])


def provenance(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """step, name, n_rows and change against the step before: the trail of a cleaning run."""
    counts = union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n_rows") for k, (name, df) in enumerate(steps)])
    return counts.withColumn("change", F.coalesce(F.col("n_rows") - F.lag("n_rows").over(Window.orderBy("step")), F.lit(0)))


def numeric_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, pct_missing, n_unique, low, median, high of number columns."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = union_all([wide.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("m")).agg(F.min("v").alias("low"), F.expr("percentile(v, 0.5, m)").alias("median"), F.max("v").alias("high")).select(F.lit(c).alias("column"), "low", "median", "high") for c in columns])
    return audit(wide).join(ends, "column").select("column", "n_missing", (100.0 * F.col("n_missing") / F.col("n_rows")).alias("pct_missing"), "n_unique", "low", "median", "high")
