"""Edits of ordered tables: stored files added, removed, renamed and moved; header patches planned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(df: DataFrame, group: list[str], order: str = "ord") -> DataFrame:
    return df.withColumn(order, F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1)


def add(stored: DataFrame, more: DataFrame, group: list[str]) -> DataFrame:
    """Rows of more (same columns) behind each group's last; names that are there already are an error."""
    last = stored.groupBy(*group).agg(F.max("ord").alias("_last"))
    known = stored.select(*group, F.lower("name").alias("_name")).distinct().withColumn("_known", F.lit(True))
    new = more.withColumn("_name", F.lower("name")).join(known, [*group, "_name"], "left").join(last, group, "left")
    clash = F.raise_error(F.concat(F.lit("stored name exists: "), "name")).cast("long")
    new = new.withColumn("ord", F.when(F.col("_known").isNotNull(), clash).otherwise(F.col("ord") + F.coalesce("_last", F.lit(-1)) + 1))
    return stored.unionByName(new.select(*stored.columns))


def remove(stored: DataFrame, names: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose name is listed, whatever its case, go; the rest is numbered anew."""
    gone = names.select(*group, F.lower("name").alias("_name")).distinct()
    left = stored.withColumn("_name", F.lower("name")).join(gone, [*group, "_name"], "left_anti").drop("_name")
    return renumbered(left, group)


def rename(stored: DataFrame, changes: DataFrame, group: list[str]) -> DataFrame:
    """changes: (group, old, new), one row for each group at most; only the first row of that name is renamed.

    A name that its group doesn't have is an error.
    """
    hit = changes.withColumn("_name", F.lower("old")).join(stored.select(*group, F.lower("name").alias("_name"), "ord"), [*group, "_name"], "left")
    missing = F.raise_error(F.concat(F.lit("no stored name: "), F.first("old"))).cast(stored.schema["ord"].dataType)
    firsts = hit.groupBy(*group).agg(F.coalesce(F.min("ord"), missing).alias("ord"), F.first("new").alias("_new"))
    return stored.join(firsts, [*group, "ord"], "left").withColumn("name", F.coalesce("_new", "name")).select(*stored.columns)


def move(stored: DataFrame, moves: DataFrame, group: list[str]) -> DataFrame:
    """moves: (group, name, by), one row for each group at most; a move out of range changes nothing."""
    counts = stored.groupBy(*group).agg(F.count("*").alias("_n"))
    hit = stored.withColumn("_name", F.lower("name")).join(moves.select(*group, F.lower("name").alias("_name"), "by"), [*group, "_name"])
    spot = hit.groupBy(*group).agg(F.min("ord").alias("_from"), F.min_by("by", "ord").alias("_by")).join(counts, group)
    spot = spot.select(*group, "_from", F.col("_by"), (F.col("_from") + F.col("_by")).alias("_to"), "_n").where("_to >= 0 and _to < _n and _by <> 0")
    joined = stored.join(spot, group, "left")
    at = (
        F.when(F.col("_to").isNull(), F.col("ord"))
        .when(F.col("ord") == F.col("_from"), F.col("_to"))
        .when((F.col("ord") > F.col("_from")) & (F.col("ord") <= F.col("_to")), F.col("ord") - 1)
        .when((F.col("ord") < F.col("_from")) & (F.col("ord") >= F.col("_to")), F.col("ord") + 1)
        .otherwise(F.col("ord"))
    )
    return joined.withColumn("ord", at).select(*stored.columns)


def patch_plan(headers: DataFrame, targets: dict[str, Column], keys: list[str]) -> DataFrame:
    """What a patch would change: keys, field, before and after, for fields whose target isn't null and differs."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), t.cast("string").alias("after"), (t.isNotNull() & ~F.col(f).eqNullSafe(t)).alias("_d")) for f, t in targets.items()))
    return headers.select(*keys, F.inline(F.filter(each, lambda x: x["_d"]))).drop("_d")
