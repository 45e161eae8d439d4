"""Joins with a table of a row for each key, where some keys have very many rows on the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_from(table: DataFrame, weight: str, most: int) -> int:
    """The least power of two for which at most `most` rows of the table have a weight of as much or more.

    A key below it has less than 2 / most of all the weight, if there are more than `most` keys at half
    the bound. At most 64 rows reach the driver.
    """
    by_size = {r["b"]: r["n"] for r in table.where(F.col(weight) > 0).groupBy(F.floor(F.log2(weight) + 1e-9).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    total, bound = 0, max(by_size, default=-1) + 1
    while bound and total + by_size.get(bound - 1, 0) <= most:
        bound -= 1
        total += by_size.get(bound, 0)
    return 1 << bound


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """rows with the columns of the table (nulls where it lacks the key), in two parts.

    table: written, a row for each key, with its rows on the other side as weight. The first part has the
    rows whose key is among the `most` frequent ones, which are broadcast, and all rows if there are no
    more keys than that. The second has the others, joined by a shuffle in which no key is hot.
    """
    bound = frequent_from(table, weight, most)
    hot, cold = table.where(F.col(weight) >= bound), table.where(F.col(weight) < bound)
    if not cold.head(1):
        return rows.join(F.broadcast(hot), on, "left"), None
    return rows.join(F.broadcast(hot), on, "inner"), rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, "left")
