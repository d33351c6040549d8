"""Candidates: versions times switch sets, filtered and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars


def in_range(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Versions (version) within any half-open range (start, end); ranges are a setting of a few rows.

    Ranges are cut at multiples of 100, so that the join is an equality.
    """
    cut = ranges.where("start < end").select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor((F.col("end") - 1) / 100))).alias("_b"))
    keyed = versions.withColumn("_b", F.floor(F.col("version") / 100))
    return keyed.join(cut, (keyed["_b"] == cut["_b"]) & (keyed["version"] >= cut["start"]) & (keyed["version"] < cut["end"]), "left_semi").drop("_b")


def filtered_arguments(args: Column, number: Column, form: Column) -> Column:
    """Names of the switches that fit; args: array of (arg, low, high, only)."""
    fit = F.filter(args, lambda a: scalars.argument_applies(number, form, a["low"], a["high"], a["only"]))
    return F.transform(fit, lambda a: a["arg"])


def enumerate_candidates(versions: DataFrame, sets: DataFrame) -> DataFrame:
    """Each version (version) with each switch set (set_no, args), known bad ones marked.

    The sets are exploded within each version's row from one array, for which
    the whole setting must fit into a row: it's a list that a user typed.
    """
    listed = sets.agg(F.array_sort(F.collect_list(F.struct("set_no", "args"))).alias("_sets"))
    rows = versions.join(F.broadcast(listed), F.lit(True)).select(*versions.columns, F.inline("_sets"))
    form = scalars.archive_format(F.col("version"), F.transform("args", lambda a: a["arg"]))
    rows = rows.withColumn("format", form).withColumn("final", filtered_arguments(F.col("args"), F.col("version"), F.col("format")))
    return rows.withColumn("skipped", scalars.known_bad(F.col("version"), F.col("format"), F.col("final"))).drop("args")


def progress_size(candidates: DataFrame, passes: int = 4) -> DataFrame:
    """Number of runs: candidates that aren't skipped, in so many attribute passes."""
    return candidates.agg((F.count_if(~F.col("skipped")) * passes).alias("runs"))
