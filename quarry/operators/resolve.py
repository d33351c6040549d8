"""Facts of archives from rows of headers: first wins, last wins, split pieces, sets, modes, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import set_key


def first_non_null(df: DataFrame, group: list[str], facts: list[str], order: str) -> DataFrame:
    """For each fact its first value that isn't null."""
    return df.groupBy(*group).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in facts))


def first_header(df: DataFrame, group: list[str], facts: list[str], order: str) -> DataFrame:
    """All facts from the first row, null or not."""
    return df.groupBy(*group).agg(F.min_by(F.struct(*facts), order).alias("_first")).select(*group, "_first.*")


def last_non_null(df: DataFrame, group: list[str], facts: list[str], order: str) -> DataFrame:
    return df.groupBy(*group).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in facts))


def resolve_split(pieces: DataFrame, group: list[str]) -> DataFrame:
    """CRC of entries (group, ord, crc, split_after): the first final piece's, else the first piece's.

    An entry's CRC is replaced only when the one held goes on in the next
    volume and the new one doesn't; so the first final piece stays.
    """
    has = F.col("crc").isNotNull()
    rank = F.when(has, F.struct("split_after", "ord", "crc"))
    return pieces.groupBy(*group).agg(F.min_by("crc", rank).alias("crc"), F.min_by("ord", rank).alias("from_ord"), F.count("*").alias("n_pieces"))


def mode_larger(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value of each group; of ties, the larger one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", value)).alias("mode"), F.max("n").alias("n"))


def archive_sets(volumes: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """Sets of volumes: key as first spelt, first ordinal, and number of volumes."""
    keyed = volumes.select(set_key(F.col(path)).alias("key"), F.col(order).alias("ord"))
    return keyed.groupBy(F.lower("key").alias("_k")).agg(F.min_by("key", "ord").alias("set_key"), F.min("ord").alias("first_ord"), F.count("*").alias("n_volumes")).drop("_k")


def issues(blocks: DataFrame, rules: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """A row for each rule that a row breaks: keys, severity, rule; one pass over the rows."""
    each = F.array(*(F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for severity, rule, broken in rules))
    return blocks.select(*keys, F.inline(F.filter(each, lambda x: x.isNotNull())))


def verdict(found: DataFrame, group: list[str]) -> DataFrame:
    """Counts of issues by severity; valid when there is no Error."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.groupBy(*group).agg(n("Error").alias("n_error"), n("Warning").alias("n_warning"), n("Info").alias("n_info")).withColumn("valid", F.col("n_error") == 0)


def proof_facts(entries: DataFrame, group: list[str], order: str, is_image: Column, compressed: Column) -> DataFrame:
    """Whether a volume holds an image, ends in one, has entries, and packs any."""
    df = entries.withColumns({"_image": is_image, "_packed": compressed})
    return df.groupBy(*group).agg(F.bool_or("_image").alias("has_image"), F.max_by("_image", order).alias("last_is_image"), (F.count("*") > 0).alias("has_entries"), F.bool_or("_packed").alias("any_compressed"))


def expanded_flags(df: DataFrame, flags: str, table: list[tuple[int, str]]) -> DataFrame:
    """A row for each flag of a table of (mask, name), with is_set."""
    each = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(n).alias("flag"), (F.col(flags).bitwiseAND(m) != 0).alias("is_set")) for m, n in table))
    return df.select("*", F.inline(each))


def resolve_times(pieces: DataFrame, group: list[str], times: list[str]) -> DataFrame:
    """Times of entries (group, ord, crc, split_after, times), which follow the CRC that resolve_split picks.

    Each time comes from the picked piece; null there, from the first piece
    with a CRC; null there too, from the first piece that has it.
    """
    has = F.col("crc").isNotNull()
    picked, first = F.when(has, F.struct(F.coalesce("split_after", F.lit(False)), F.col("ord"))), F.when(has, F.col("ord"))
    one = lambda t: F.coalesce(F.min_by(t, picked), F.min_by(t, first), F.min_by(t, F.when(F.col(t).isNotNull(), F.col("ord"))))
    return pieces.groupBy(*group).agg(*(one(t).alias(t) for t in times))


def set_facts(files: DataFrame, facts: DataFrame, name: str = "name") -> DataFrame:
    """Files of sets with the facts (one row for each name) of their names, whatever the case; null where there are none."""
    known = facts.withColumn("_n", F.lower(name)).drop(name)
    return files.withColumn("_n", F.lower(name)).join(known, "_n", "left").drop("_n")


def as_map(df: DataFrame, group: list[str], key: str, value: str, order: str) -> DataFrame:
    """(group, entries): a map of each group's keys to their first value; a group is a file's or set's, so that its map is small."""
    firsts = df.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.min_by(value, order).alias(value))
    return firsts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("entries"))


def all_or_none(rows: DataFrame, group: list[str], done: Column) -> DataFrame:
    """Rows of the groups of which every row is done (null is not); groups with any other row go as a whole."""
    whole = rows.groupBy(*group).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("_all")).where("_all").select(*group)
    return rows.join(whole, group, "left_semi")
