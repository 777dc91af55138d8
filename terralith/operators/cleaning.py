"""Cleaning: sentinels, rule cascades, first-wins duplicates, vocabularies, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_if(col: Column, *sentinels) -> Column:
    """The column without sentinel values."""
    return F.when(~col.isin(*sentinels), col)


def null_unless(col: Column, low, high) -> Column:
    return F.when(col.between(low, high), col)


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """Name of the first rule that holds; a rule that is unknown (null) doesn't hold."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first by order: the survivor is the same in every run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def normalise(col: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, single spaces; then the controlled word, where there is one."""
    plain = F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")
    if not vocabulary:
        return plain
    words = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.coalesce(words[plain], plain)


def audit(df: DataFrame) -> DataFrame:
    """column, n_rows, n_missing, n_unique of every column. Each column is counted by its values first, so no
    row is written once a column into one wide aggregate."""
    whole = df.agg(F.count("*").alias("n_rows"))

    def one(c: str) -> DataFrame:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("m"))
        missing = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("m"))), F.lit(0))
        return values.agg(missing.alias("n_missing"), F.count("v").alias("n_unique")).select(F.lit(c).alias("column"), "n_missing", "n_unique")

    return union_all([one(c) for c in df.columns]).join(F.broadcast(whole)).select("column", "n_rows", "n_missing", "n_unique")


def fill_median(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Missing values become the group's median; a flag says which. Medians come from an aggregate over
    counted values and are joined back: no window holds a group."""
    counted = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("m"))
    medians = counted.groupBy(*by).agg(F.expr(f"percentile({col}, 0.5, m)").alias("__median"))
    flagged = df.join(medians, by, "left").withColumn(f"{col}_imputed", F.col(col).isNull())
    return flagged.withColumn(f"{col}_filled", F.coalesce(F.col(col), F.col("__median"))).drop("__median")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
