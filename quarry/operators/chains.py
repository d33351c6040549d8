"""Volumes into chains, entries over volumes, and where rebuilt files go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import names


def ordered_chains(listed: DataFrame) -> DataFrame:
    """(manifest, chain_no, position, name) of (manifest, line_no, name): volumes by set.

    Sets come in the order of their first line, volumes in the order of their
    lines; names that are no volumes go.
    """
    v = listed.where(names.is_volume(F.col("name"))).withColumn("_key", F.lower(names.set_key(F.col("name"))))
    firsts = v.groupBy("manifest", "_key").agg(F.min("line_no").alias("_first"))
    firsts = firsts.withColumn("chain_no", F.row_number().over(Window.partitionBy("manifest").orderBy("_first")) - 1)
    own = Window.partitionBy("manifest", "_key").orderBy("line_no")
    return v.withColumn("position", F.row_number().over(own) - 1).join(firsts, ["manifest", "_key"]).select("manifest", "chain_no", "position", "name")


def natural_order(volumes: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """volumes with their position in the group by part number or old style, then by name."""
    w = Window.partitionBy(*group).orderBy(names.volume_order(F.col(name)), F.lower(name), name)
    return volumes.withColumn("position", F.row_number().over(w) - 1)


def on_disk_order(volumes: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """Volumes as a folder lists them: parts by text when there are any, else .rar, .rNN, then .sNN to .zNN."""
    part = F.col(name).rlike(names.PART)
    any_part = F.max(part).over(Window.partitionBy(*group))
    ext = F.lower(names.extension(F.col(name)))
    rank = F.when(part, 0).when(ext == ".rar", 1).when(ext.rlike(r"^\.r..$"), 2).when(ext.rlike(r"^\.[s-z]\d\d$"), 3)
    kept = volumes.withColumn("_any", any_part).withColumn("_rank", rank).where(F.col("_rank").isNotNull() & (~F.col("_any") | (F.col("_rank") == 0)))
    w = Window.partitionBy(*group).orderBy("_rank", F.when(F.col("_any"), F.col(name)).otherwise(F.lower(name)), name)
    return kept.withColumn("position", F.row_number().over(w) - 1).drop("_any", "_rank")


def entries(blocks: DataFrame, volumes: DataFrame) -> DataFrame:
    """(set_key, name, ...) of blocks over volumes (path, set_key, position): each entry once, by lower-case name.

    Sizes are summed over its pieces; other facts come from the first piece,
    the checksum from the last.
    """
    files = blocks.where((F.col("name").isNotNull()) & (((F.col("format") == 4) & (F.col("type") == 0x74)) | ((F.col("format") == 5) & (F.col("type") == 2)))).join(volumes, "path")
    order = F.struct("position", "block_no")
    own = files.groupBy("set_key", F.lower("name").alias("_n")).agg(
        F.min_by("name", order).alias("name"), F.min_by("method", order).alias("method"), F.min_by("is_dir", order).alias("is_dir"), F.min_by("unpacked_size", order).alias("unpacked_size"),
        F.max_by("file_crc", order).alias("file_crc"), F.sum("add_size").alias("packed_size"), F.count("*").alias("n_pieces"), F.min_by("split_before", order).alias("starts_before"), F.max_by("split_after", order).alias("goes_on"),
    )
    return own.drop("_n")


def skip_reason(limit: int) -> Column:
    """Why an entry's bytes aren't read; null when they are: stored, whole and within the limit."""
    stored = F.col("method").isin(0, 0x30)
    return (
        F.when(F.col("is_dir"), "directory")
        .when(F.col("starts_before") | F.col("goes_on"), "volumes missing")
        .when(F.col("unpacked_size") > limit, "too large")
        .when(~stored, "compressed")
        .when(F.col("packed_size") != F.col("unpacked_size"), "sizes differ")
    )


def read_entries(blocks: DataFrame, volumes: DataFrame, content: DataFrame, limit: int = 1 << 30) -> DataFrame:
    """(set_key, name, skip_reason, data) of stored entries over their volumes; data that fails its CRC is skipped too."""
    from quarry.operators.extents import assemble

    facts = entries(blocks, volumes).withColumn("skip_reason", skip_reason(limit)).withColumn("entry", F.concat_ws("|", "set_key", F.lower("name")))
    pieces = blocks.where(F.col("name").isNotNull() & F.col("type").isin(0x74, 2)).join(volumes, "path").withColumn("entry", F.concat_ws("|", "set_key", F.lower("name")))
    pieces = pieces.join(facts.where("skip_reason is null").select("entry"), "entry", "left_semi").join(content, "path")
    cut = F.substring("content", (F.col("data_offset") + 1).cast("int"), F.col("add_size").cast("int"))
    whole = assemble(pieces.select("entry", F.row_number().over(Window.partitionBy("entry").orderBy("position", "block_no")).alias("ord"), cut.alias("data")), "entry")
    out = facts.join(whole, "entry", "left")
    wrong = F.col("data").isNotNull() & (F.crc32("data") != F.col("file_crc"))
    return out.select("set_key", "name", F.when(wrong, "checksum differs").otherwise(F.col("skip_reason")).alias("skip_reason"), F.when(~wrong, F.col("data")).alias("data"))


def rename_plan(produced: DataFrame, expected: DataFrame, group: list[str]) -> DataFrame:
    """(group, position, source, dest) of produced and expected names by position; nothing for groups of unequal counts."""
    n = lambda df, c: df.groupBy(*group).agg(F.count("*").alias(c))
    whole = n(produced, "_p").join(n(expected, "_e"), group).where("_p = _e").select(*group)
    both = produced.select(*group, "position", F.col("name").alias("source")).join(expected.select(*group, "position", F.col("name").alias("dest")), [*group, "position"])
    return both.join(whole, group, "left_semi")


def source_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(name, path): for each wanted name the best file: same relative path, same name in the root, then anywhere whatever the case."""
    p = present.select("path", F.lower(names.last_segment(F.col("path"))).alias("_n"))
    w = wanted.select("name", F.lower(names.last_segment(F.col("name"))).alias("_n"), F.replace("name", F.lit("\\"), F.lit("/")).alias("_rel"))
    rank = F.when(F.col("path") == F.col("_rel"), 0).when(F.col("path") == names.last_segment(F.col("_rel")), 1).otherwise(2)
    return w.join(p, "_n", "left").groupBy("name").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.struct(rank, F.col("path")))).alias("path"))


def languages_diz(index_files: DataFrame) -> DataFrame:
    """(set_key, text): the language lines of all .idx entries of (set_key, name, data), by name."""
    from quarry.sources.manifests import language_lines

    rows = index_files.where(F.lower("name").like("%.idx")).select("set_key", "name", language_lines(F.decode("data", "ISO-8859-1")).alias("lines")).where("lines <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("name", "lines"))), lambda x: x["lines"])
    return rows.groupBy("set_key").agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("text"))


def created_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(path, found): for each expected path the first that is present of itself, .part01.rar, .part1.rar and .rar."""
    base = F.regexp_replace("path", r"\.[^./\\]*$", "")
    tried = expected.select("path", F.posexplode(F.array("path", *(F.concat(base, F.lit(e)) for e in (".part01.rar", ".part1.rar", ".rar")))).alias("_rank", "_tried"))
    there = present.select(F.col("path").alias("_tried")).distinct().withColumn("_hit", F.lit(True))
    return tried.join(there, "_tried", "left").groupBy("path").agg(F.min_by("_tried", F.when(F.col("_hit"), F.col("_rank"))).alias("found"))


def placement(plan: DataFrame, present: DataFrame, group: list[str]) -> DataFrame:
    """plan (group, source, dest) with action: "stay" or "move"; "refused" for all of a group of which a target is taken.

    A target is taken when a file is there already, other than the source
    itself, or when two rows of the group want it.
    """
    there = present.select(F.lower("path").alias("_dest")).distinct().withColumn("_there", F.lit(True))
    rows = plan.withColumns({"_dest": F.lower("dest"), "_stay": F.lower("source") == F.lower("dest")}).join(there, "_dest", "left")
    wanted = rows.groupBy(*group, "_dest").agg(F.count("*").alias("_n"), F.bool_or(~F.col("_stay") & F.col("_there").isNotNull()).alias("_taken"))
    bad = wanted.groupBy(*group).agg(F.bool_or((F.col("_n") > 1) | F.col("_taken")).alias("_bad"))
    action = F.when(F.col("_bad"), "refused").when(F.col("_stay"), "stay").otherwise("move")
    return rows.join(bad, group).withColumn("action", action).select(*plan.columns, "action")


def sum_hashes(blocks: DataFrame, volumes: DataFrame, content: DataFrame) -> DataFrame:
    """(set_key, name, size, hash) of stored entries of 64 KiB and more over their volumes; entries whose start is missing give none."""
    from quarry.sources.readers import oso_hashes

    whole = read_entries(blocks, volumes, content).where(F.col("data").isNotNull())
    key = F.to_json(F.struct("set_key", "name")).alias("path")
    hashed = oso_hashes(whole.select(key, F.col("data").alias("content")))
    kinds = f"set_key {blocks.join(volumes, 'path').schema['set_key'].dataType.simpleString()}, name string"
    return hashed.select(F.from_json("path", kinds).alias("_k"), "size", "hash").select("_k.*", "size", "hash")
