"""Differences between two tables: by key, by position, by occurrence, by tree path.

Every diff is one full outer join on its key; nothing is collected, and rows
that are equal are dropped right after it.  Properties compare as text with
null equal to "", and show as "N/A" when missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def differs(left: Column, right: Column) -> Column:
    return F.coalesce(left.cast("string"), F.lit("")) != F.coalesce(right.cast("string"), F.lit(""))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each key, the one that comes first; combines before it shuffles."""
    row = F.struct(*(F.col(c) for c in df.columns))
    best = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row"))
    return best.select("_row.*")


def sides(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join: keys, l_<value>, r_<value>, and the type Removed, Added or Both."""
    a = left.select(*keys, *(F.col(v).alias(f"l_{v}") for v in values), F.lit(True).alias("_l"))
    b = right.select(*keys, *(F.col(v).alias(f"r_{v}") for v in values), F.lit(True).alias("_r"))
    kind = F.when(F.col("_r").isNull(), "Removed").when(F.col("_l").isNull(), "Added").otherwise("Both")
    return a.join(b, keys, "full_outer").withColumn("diff_type", kind).drop("_l", "_r")


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows only on one side, and rows of which a value differs, as Removed, Added and Modified."""
    both = sides(left, right, keys, values)
    changed = F.lit(False)
    for v in values:
        changed = changed | differs(F.col(f"l_{v}"), F.col(f"r_{v}"))
    return both.where((F.col("diff_type") != "Both") | changed).withColumn("diff_type", F.when(F.col("diff_type") == "Both", "Modified").otherwise(F.col("diff_type")))


def property_rows(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each property that differs, of keys on both sides: property, left_value, right_value."""
    renamed = lambda df, side: df.select(*keys, *(F.col(v).alias(f"{side}_{v}") for v in values))
    both = renamed(left, "l").join(renamed(right, "r"), keys)
    each = F.array(*(F.struct(F.lit(v).alias("property"), shown(F.col(f"l_{v}")).alias("left_value"), shown(F.col(f"r_{v}")).alias("right_value"), differs(F.col(f"l_{v}"), F.col(f"r_{v}")).alias("_d")) for v in values))
    return both.select(*keys, F.inline(F.filter(each, lambda x: x["_d"]))).drop("_d")


def positioned(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df with each row's position in its group, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def positional_diff(left: DataFrame, right: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keyed_diff by position within a group."""
    return keyed_diff(positioned(left, group, order), positioned(right, group, order), [*group, "position"], values)


def occurrence_diff(left: DataFrame, right: DataFrame, identity: list[str], order: list[str], values: list[str]) -> DataFrame:
    """keyed_diff by identity and the number of its occurrence."""
    return keyed_diff(positioned(left, identity, order, "occurrence"), positioned(right, identity, order, "occurrence"), [*identity, "occurrence"], values)


def element_paths(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """(path, node columns) of a tree of (node_id, parent_id, name, ordinal): /name[occurrence]/...

    One join for each level; stops at the first level without nodes.
    """
    own = Window.partitionBy("parent_id", "name").orderBy("ordinal")
    n = F.row_number().over(own) - 1
    named = nodes.withColumn("_step", F.concat(F.lit("/"), F.col("name"), F.when(n > 0, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise("")))
    level = named.where("parent_id is null").select(F.col("node_id"), F.col("_step").alias("path"))
    out = level
    for _ in range(depth):
        level = named.join(level.select(F.col("node_id").alias("parent_id"), F.col("path").alias("_up")), "parent_id").select("node_id", F.concat("_up", "_step").alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return nodes.join(out, "node_id")


def tree_diff(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    """keyed_diff of two trees by element path."""
    return keyed_diff(element_paths(left), element_paths(right), ["path"], values)


def same_bytes(left: Column, right: Column) -> Column:
    """Whether two payloads are equal, by length and digest."""
    return (F.octet_length(left) == F.octet_length(right)) & (F.sha2(left, 256) == F.sha2(right, 256))


#: Fields that follow from the other fields of a block.
DERIVED_FIELDS = ("Header CRC", "CRC32")


def _zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the array fields of (left, right) fields by number, of blocks on both sides; the shorter side is filled with nulls."""

    def block(df: DataFrame, name: str) -> DataFrame:
        fields = F.array_sort(F.collect_list(F.struct("field_no", "name", "value")))
        return df.groupBy(*keys).agg(fields.alias(name), F.max("data_size").alias(f"{name}_size"))

    pairs = F.arrays_zip("_l", "_r")
    return block(left, "_l").join(block(right, "_r"), keys).withColumn("fields", pairs)


def field_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of (keys, field_no, name, value, data_size) that differ by number, of blocks on both sides.

    (keys, field_no, property, left_value, right_value): the property is the
    left name, else the right one; a field that one side lacks is "N/A" there.
    Derived fields are left out.  A block's fields are few, so that they are
    collected as an array: one shuffle of each side, none of the pairs.
    """
    row = lambda p, at: F.struct(at.alias("field_no"), F.coalesce(p["_l"]["name"], p["_r"]["name"]).alias("property"), shown(p["_l"]["value"]).alias("left_value"), shown(p["_r"]["value"]).alias("right_value"))
    rows = F.transform(F.col("fields"), row)
    kept = F.filter(rows, lambda x: (x["left_value"] != x["right_value"]) & ~F.coalesce(x["property"].isin(*DERIVED_FIELDS), F.lit(False)))
    return _zipped(left, right, keys).select(*keys, F.inline(kept))


def quick_check(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, differs) of blocks on both sides: whether their data sizes or any values differ, derived fields too; null equals ""."""
    text = lambda x: F.coalesce(x["value"], F.lit(""))
    fields = F.exists(F.col("fields"), lambda p: text(p["_l"]) != text(p["_r"]))
    return _zipped(left, right, keys).select(*keys, (~F.col("_l_size").eqNullSafe(F.col("_r_size")) | fields).alias("differs"))


def compared(pairs: DataFrame, keys: list[str], by_kind: dict[str, Column | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Differences (keys, property, left_value, right_value) of pairs (keys, left_kind, right_kind, left_type, right_type, ...).

    Pairs of one kind have the differences of that kind: an array column of
    (property, left_value, right_value), null or empty for none, or a function
    of the pairs that returns keys and those columns.  A pair of unequal or
    unknown kinds gives one row, "File Type", with the names of the types
    ("Unknown" for none).  Columns are found in one pass over the pairs; each
    function reads them once more.
    """
    same = F.coalesce((F.col("left_kind") == F.col("right_kind")) & F.col("left_kind").isin(*by_kind), F.lit(False))
    name = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c.replace("type", "value"))
    found = F.when(~same, F.array(F.struct(F.lit("File Type").alias("property"), name("left_type"), name("right_type"))))
    for kind, differences in by_kind.items():
        if isinstance(differences, Column):
            found = found.when(F.col("left_kind") == kind, differences)
    out = pairs.select(*keys, F.inline(found))
    for kind, differences in by_kind.items():
        if not isinstance(differences, Column):
            out = out.unionByName(differences(pairs.where(same & (F.col("left_kind") == kind))).select(*out.columns))
    return out
