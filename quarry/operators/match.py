"""Expected against produced: by position, as multisets, with fallback keys; ambiguity and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import last_segment


def zip_verify(produced: DataFrame, expected: DataFrame, group: list[str]) -> DataFrame:
    """Produced (group, position, crc) against expected (group, position, name, crc), where both have a row."""
    p = produced.select(*group, "position", F.col("crc").alias("actual"))
    e = expected.select(*group, "position", "name", F.col("crc").alias("expected"))
    return p.join(e, [*group, "position"]).withColumn("matches", F.coalesce(F.lower("actual") == F.lower("expected"), F.col("actual").isNull() & F.col("expected").isNull()))


def zip_result(produced: DataFrame, expected: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group: counts, whether all match, and the first position that doesn't."""
    n = lambda df, name: df.groupBy(*group).agg(F.count("*").alias(name))
    pairs = zip_verify(produced, expected, group).groupBy(*group).agg(F.min(F.when(~F.col("matches"), F.col("position"))).alias("first_mismatch"))
    counts = n(produced, "n_produced").join(n(expected, "n_expected"), group, "full_outer").na.fill(0, ["n_produced", "n_expected"])
    out = counts.join(pairs, group, "left")
    same = F.col("n_produced") == F.col("n_expected")
    return out.withColumn("count_mismatch", ~same).withColumn("all_match", same & F.col("first_mismatch").isNull())


def multiset_match(expected: DataFrame, actual: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """Whether each group's names are the same multiset: last segments, whatever their case."""
    key = F.lower(last_segment(F.col(name))).alias("_key")
    e = expected.select(*group, key, F.lit(1).alias("_n"))
    a = actual.select(*group, key, F.lit(-1).alias("_n"))
    sums = e.unionByName(a).groupBy(*group, "_key").agg(F.sum("_n").alias("_n"))
    return sums.groupBy(*group).agg(F.bool_and(F.col("_n") == 0).alias("matches"))


def lookup_fallback(items: DataFrame, known: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Value of each item by its first key, else by its second; items with neither go.

    Positions that are counted afterwards (diff.positioned) close such gaps.
    """
    by = lambda k, name: known.select(F.col(key).alias(k), F.col(value).alias(name))
    found = items.join(by(first, "_a"), first, "left").join(by(second, "_b"), second, "left")
    return found.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b").where(F.col(value).isNotNull())


def missing(items: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(present.select(*keys).distinct(), keys, "left_anti")


def ambiguous(names: DataFrame, name: str = "name") -> DataFrame:
    """Last segments, in lower case, that several full names share."""
    key = F.lower(last_segment(F.col(name))).alias("segment")
    return names.select(key, F.lower(name).alias("_full")).distinct().groupBy("segment").agg(F.count("*").alias("n")).where("n > 1")


def source_conflicts(files: DataFrame) -> DataFrame:
    """Names of (name, source) that several sources claim; repeats of a source are silent."""
    once = files.select(F.lower("name").alias("name"), "source").distinct()
    return once.groupBy("name").agg(F.count("*").alias("n_sources")).where("n_sources > 1")


def seen_before(df: DataFrame, digest: str, order: str) -> DataFrame:
    """df with is_duplicate: whether an earlier row has the same digest.

    A row is the first when its order is the least of its digest: a grouped
    minimum and a join, so that a very common digest isn't sorted in one task.
    """
    least = df.groupBy(F.col(digest).alias("_digest")).agg(F.min(order).alias("_first"))
    joined = df.join(least, F.col(digest).eqNullSafe(F.col("_digest")), "left")
    return joined.withColumn("is_duplicate", F.col(order) > F.col("_first")).drop("_first", "_digest")


def first_match(runs: DataFrame, group: list[str]) -> DataFrame:
    """Fold (group, ord, found, combination): whether any was found, the first combination, how many."""
    return runs.groupBy(*group).agg(
        F.bool_or("found").alias("any_found"),
        F.min_by(F.when(F.col("found"), F.col("combination")), F.when(F.col("found"), F.col("ord"))).alias("first_combination"),
        F.count_if("found").alias("n_found"),
    )


def semijoin_or_all(items: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a wanted key, or all items when there is none."""
    hit = items.join(wanted.select(*keys).distinct(), keys, "left_semi")
    none = hit.agg(F.count("*").alias("_n")).where("_n = 0")  # one row at most
    return hit.unionByName(items.join(F.broadcast(none.select(F.lit(True).alias("_all"))), F.lit(True), "left_semi"))


def select_sections(sections: DataFrame, selectors: DataFrame) -> DataFrame:
    """Sections (name) that a selector names in full, or by last segment when it has no separator."""
    s = sections.withColumn("_full", F.lower(F.replace("name", F.lit("\\"), F.lit("/")))).withColumn("_base", F.lower(last_segment(F.col("name"))))
    q = selectors.select(F.lower(F.replace("selector", F.lit("\\"), F.lit("/"))).alias("_q"))
    full, base = q.where(F.contains("_q", F.lit("/"))), q.where(~F.contains("_q", F.lit("/")))
    return s.join(full, s["_full"] == full["_q"], "left_semi").unionByName(s.join(base, s["_base"] == base["_q"], "left_semi")).select(*sections.columns).distinct()


def running(df: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """df with before and upto: the group's sizes so far, without and with this row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upto", F.sum(size).over(w)).withColumn("before", F.col("upto") - F.col(size))


def reconciled(volumes: DataFrame, stored: DataFrame, group: list[str]) -> DataFrame:
    """Volumes (group, ord, name, source) whose source is no stored file's (group, name, source) and no earlier volume's.

    conflict tells that a stored file or an earlier volume has the same name,
    whatever its case, from another source.  Grouped minima, no sorted groups.
    """
    source = F.lower("source").alias("_source")
    firsts = volumes.groupBy(*group, source).agg(F.min_by(F.struct("ord", "name", "source"), "ord").alias("_v")).join(stored.select(*group, source).distinct(), [*group, "_source"], "left_anti")
    kept = firsts.select(*group, "_v.*").withColumn("_name", F.lower("name"))
    claims = kept.select(*group, "_name", F.col("ord").cast("long").alias("_at")).unionByName(stored.select(*group, F.lower("name").alias("_name"), F.lit(None).cast("long").alias("_at")))
    owner = claims.groupBy(*group, "_name").agg(F.min("_at").alias("_first"), F.bool_or(F.col("_at").isNull()).alias("_stored"))
    return kept.join(owner, [*group, "_name"]).withColumn("conflict", F.col("_stored") | (F.col("ord") > F.col("_first"))).select(*group, "ord", "name", "source", "conflict")


def first_volume_gate(produced: DataFrame, known: DataFrame, digest: str, order: str, delete_all: bool = False, delete_repeated: bool = False) -> DataFrame:
    """produced with matched (its digest is known, whatever the case), is_duplicate and keep (files that stay on disk)."""
    wanted = known.select(F.lower(F.trim(digest)).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    seen = seen_before(produced, digest, order).withColumn("_key", F.lower(F.trim(digest)))
    out = seen.join(wanted, "_key", "left").withColumn("matched", F.col("_hit").isNotNull()).drop("_key", "_hit")
    gone = F.lit(delete_all) | (F.lit(delete_repeated) & F.col("is_duplicate"))
    return out.withColumn("keep", F.col("matched") | ~gone)


def full_set_gate(produced: DataFrame, expected: DataFrame, group: list[str], complete: bool = True) -> DataFrame:
    """(group, passes, reason): whether all volumes are as expected; also where nothing is expected or complete is off."""
    pairs = zip_verify(produced, expected, group).groupBy(*group).agg(F.min_by(F.struct("name", "expected", "actual"), F.when(~F.col("matches"), F.col("position"))).alias("_m"))
    result = zip_result(produced, expected, group).join(pairs, group, "left")
    why = F.when(F.col("count_mismatch"), F.format_string("produced %d volume(s), expected %d", "n_produced", "n_expected")).otherwise(
        F.format_string("%s CRC mismatch (expected %s, got %s)", "_m.name", "_m.expected", "_m.actual")
    )
    passes = F.lit(not complete) | (F.col("n_expected") == 0) | F.col("all_match")
    return result.select(*group, passes.alias("passes"), F.when(~passes, why).alias("reason"))


def verified_tracks(tracks: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Tracks (group, track_no, signature_size) with match_offset from found (group, track_no, offset).

    An offset of 0 counts as not found; tracks that aren't found keep 0.
    """
    at = found.groupBy(*group, "track_no").agg(F.min(F.nullif(F.col("offset"), F.lit(0))).alias("_at"))
    return tracks.join(at, [*group, "track_no"], "left").withColumn("match_offset", F.coalesce(F.when(F.col("_at") > 0, F.col("_at")), F.lit(0).cast("long"))).drop("_at")


def unlocated(verified: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_tracks, n_located, warning): a warning where fewer tracks are located than have a signature."""
    located = F.count_if(F.col("match_offset") > 0)
    return verified.groupBy(*group).agg(F.count("*").alias("n_tracks"), located.alias("n_located"), (located < F.count_if(F.col("signature_size") > 0)).alias("warning"))
