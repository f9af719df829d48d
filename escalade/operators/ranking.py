"""AUROC and slices as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import finite

CUTS = 64


def with_rows_before(counts: DataFrame, groups: list[str]) -> DataFrame:
    """counts(groups, s, c, ...), one row a distinct value s, with `before`: the sum of c over the group's smaller values.

    Sums come in two steps, over about CUTS cells of each group and inside a cell, so that a large group is not sorted by
    one task.
    """
    cuts = counts.groupBy(*groups).agg(F.percentile_approx("s", [k / CUTS for k in range(1, CUTS)], 1000).alias("cuts"))
    placed = (counts.join(cuts, groups) if groups else counts.crossJoin(F.broadcast(cuts))).withColumn("cell", F.size(F.filter("cuts", lambda b: b < F.col("s")))).drop("cuts")
    totals = placed.groupBy(*groups, "cell").agg(F.sum("c").alias("cell_c"))
    cell_before = totals.select(*groups, "cell", (F.sum("cell_c").over(Window.partitionBy(*groups).orderBy("cell")) - F.col("cell_c")).alias("cell_before"))
    inside = Window.partitionBy(*groups, "cell").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(cell_before, [*groups, "cell"]).withColumn("before", F.col("cell_before") + F.sum("c").over(inside) - F.col("c")).drop("cell", "cell_before")


def average_rank() -> Column:
    """Of a distinct value with rows before it; ties share the mean of their ranks."""
    return F.col("before") + (F.col("c") + 1) / F.lit(2.0)


def auroc(rows: DataFrame, groups: list[str], label: Column, score: Column) -> DataFrame:
    """(groups, n, n_pos, auroc): Mann-Whitney with average ranks for ties over finite scores; NaN for one class. Rows shrink to distinct scores first."""
    kept = rows.select(*groups, label.cast("int").alias("y"), score.cast("double").alias("s")).where(finite(F.col("s")) & F.col("y").isNotNull())
    distinct = kept.groupBy(*groups, "s").agg(F.count("*").alias("c"), F.sum("y").alias("p"))
    sums = with_rows_before(distinct, groups).groupBy(*groups).agg(F.sum("c").alias("n"), F.sum("p").alias("n_pos"), F.sum(average_rank() * F.col("p")).alias("r"))
    n1, n0 = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    value = F.when((n1 > 0) & (n0 > 0), (F.col("r") - n1 * (n1 + 1) / 2.0) / F.when((n1 > 0) & (n0 > 0), n1 * n0).otherwise(F.lit(1.0))).otherwise(F.lit(float("nan")))
    return sums.select(*groups, "n", "n_pos", value.alias("auroc"))


def tiled(rows: DataFrame, tiles: int, group: str, value: str, key: str) -> DataFrame:
    """rows with `tile`, 1 to `tiles`: the group's rows by value, then key, in tiles of equal size, the first ones larger by one where it does not come out even. key: a string whose first two characters part it evenly."""
    part = F.substring(F.col(key), 1, 2).alias("part")
    parts = rows.groupBy(group, F.col(value).alias("s"), part).agg(F.count("*").alias("c"))
    part_before = parts.withColumn("part_before", F.sum("c").over(Window.partitionBy(group, "s").orderBy("part")) - F.col("c")).drop("c")
    values = with_rows_before(parts.groupBy(group, "s").agg(F.sum("c").alias("c")), [group]).select(group, "s", "before")
    sizes = parts.groupBy(group).agg(F.sum("c").alias("n"))  # one row a group
    own = F.row_number().over(Window.partitionBy(group, "s", "part").orderBy(key))
    numbered = rows.withColumns({"s": F.col(value), "part": part}).withColumn("own", own).join(part_before, [group, "s", "part"]).join(values, [group, "s"]).join(F.broadcast(sizes), group)
    at = F.col("before") + F.col("part_before") + F.col("own") - 1
    more, size = F.col("n") % tiles, F.floor(F.col("n") / tiles)
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return numbered.withColumn("tile", tile.cast("long")).drop("s", "part", "own", "part_before", "before", "n")


def sliced(rows: DataFrame, source: str = "source", is_mc: str = "is_mc") -> DataFrame:
    """rows once for each slice they belong to: pooled, mc_pooled (only where some, not all, rows are multiple choice), their source."""
    share = rows.agg(F.sum(F.col(is_mc).cast("int")).alias("__mc"), F.count("*").alias("__n")).select(((F.col("__mc") > 0) & (F.col("__mc") < F.col("__n"))).alias("__mixed"))
    names = F.array_compact(F.array(F.lit("pooled"), F.when(F.col(is_mc) & F.col("__mixed"), F.lit("mc_pooled")), F.col(source)))
    return rows.crossJoin(F.broadcast(share)).withColumn("slice", F.explode(names)).drop("__mixed")


def accuracy(ok: Column) -> Column:
    """Mean of a boolean over the rows where it is known; NaN without any."""
    return F.coalesce(F.avg(ok.cast("double")), F.lit(float("nan")))
