"""Table contracts Spark does not enforce, as violation counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _row(name: str, rule: str, count: Column) -> list[Column]:
    return [F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), count.cast("bigint").alias("violations")]


def check_rows(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(r) for r, ok in rules.items()])
    rows = F.array(*[F.struct(*_row(name, r, F.coalesce(F.col(f"`{r}`"), F.lit(0)))) for r in rules])
    return counted.select(F.inline(rows))


def check_unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows too many for the key to be unique."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.agg(extra.alias("x")).select(*_row(name, f"unique {', '.join(keys)}", F.col("x")))


def allowed(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isin(*values)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
