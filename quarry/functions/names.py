"""Names of files and volumes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r"(?i)\.part(\d+)(\.rar)$"


def last_segment(path: Column) -> Column:
    """What follows the last separator of either kind."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def extension(name: Column) -> Column:
    """The extension with its dot; empty without one or with nothing behind the dot."""
    return F.regexp_extract(last_segment(name), r"\.[^.]+$", 0)


def base_name(name: Column) -> Column:
    """The name without a trailing .partN.rar, else without its extension."""
    return F.when(name.rlike(PART), F.regexp_replace(name, PART, "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def directory(path: Column) -> Column:
    """What precedes the last separator, with forward slashes and none at the ends."""
    cut = F.regexp_replace(path, r"[^/\\]*$", "")
    return F.regexp_replace(F.replace(cut, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def set_key(path: Column) -> Column:
    """Directory and base name: equal for all volumes of a set."""
    folder, base = directory(path), base_name(last_segment(path))
    return F.when(folder == "", base).otherwise(F.concat_ws("/", folder, base))


def is_volume(name: Column) -> Column:
    """.rar, a letter and two digits, or three digits."""
    return extension(name).rlike(r"(?i)^\.(rar|\p{L}\d{2}|\d{3})$")


def part_number(name: Column) -> Column:
    """The number in the last .partN.rar of a name, else null."""
    found = F.regexp_extract(F.lower(last_segment(name)), r"^.*\.part(\d{1,9})\.rar", 1)
    return F.when(found != "", found.cast("int"))


def old_order(name: Column) -> Column:
    """.rar first, then letters from r with two digits, then three digits; all else last."""
    ext = F.lower(extension(name))
    letter = (F.ascii(F.substring(ext, 2, 1)) - F.ascii(F.lit("r"))) * 100
    return (
        F.when(ext == ".rar", -1)
        .when(ext.rlike(r"^\.[a-z]\d\d$"), letter + F.substring(ext, 3, 2).try_cast("int"))
        .when(ext.rlike(r"^\.\d{3}$"), F.substring(ext, 2, 3).try_cast("int"))
        .otherwise(2**31 - 1)
    )


def volume_order(name: Column) -> Column:
    """Sort key of volumes of one set: the part number, else the old style's order."""
    return F.coalesce(part_number(name), old_order(name))


def next_old_volume(path: Column) -> Column:
    """rar -> r00, r99 -> s00, 099 -> 100; null for other names."""
    ext = extension(path)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(ext))
    letter, number = F.substring(ext, 2, 1), F.substring(ext, 3, 2).try_cast("int")
    digits = F.regexp_extract(ext, r"^\.(\d{1,9})$", 1)
    rolled = F.when(number == 99, F.concat(F.char(F.ascii(letter) + 1), F.lit("00"))).otherwise(F.concat(letter, F.lpad((number + 1).cast("string"), 2, "0")))
    after = (digits.try_cast("int") + 1).cast("string")
    return (
        F.when(ext.rlike(r"(?i)^\.rar$"), F.concat(stem, F.when(letter == "R", ".R00").otherwise(".r00")))
        .when(ext.rlike(r"^\.[r-zR-Z]\d\d$"), F.concat(stem, F.lit("."), rolled))
        .when(digits != "", F.concat(stem, F.lit("."), F.lpad(after, F.greatest(F.length(digits), F.length(after)), F.lit("0"))))
    )


def next_new_volume(path: Column) -> Column:
    """part09 -> part10, part99 -> part100, with the width kept; null for other names."""
    digits = F.regexp_extract(path, PART, 1)
    after = (digits.try_cast("int") + 1).cast("string")
    head = F.regexp_extract(path, r"(?i)^(.*\.part)\d+\.rar$", 1)
    return F.when(digits != "", F.concat(head, F.lpad(after, F.greatest(F.length(digits), F.length(after)), F.lit("0")), F.regexp_extract(path, PART, 2)))


def next_volume(path: Column, old_naming: Column) -> Column:
    return F.when(old_naming, next_old_volume(path)).otherwise(next_new_volume(path))


def second_volumes(folder: Column, base: Column) -> Column:
    """Names that the second volume of a set may have, in the order to try them."""
    return F.transform(F.array(*map(F.lit, (".part02.rar", ".part002.rar", ".part2.rar", ".r00"))), lambda s: F.concat(folder, F.lit("/"), base, s))


def normal_path(path: Column) -> Column:
    """Forward slashes, no ./ in front and no separators at the ends; null if empty or with a dot segment."""
    p = F.replace(F.btrim(path, F.lit(" \t\n\x0b\f\r")), F.lit("\\"), F.lit("/"))
    p = F.btrim(F.regexp_replace(p, r"^(?:\./)++", ""), F.lit("/"))
    return F.when((p != "") & ~F.exists(F.split(p, "/"), lambda s: s.isin(".", "..")), p)


def name_error(name: Column) -> Column:
    """Why a logical name is refused: blank, rooted or segment; null for a good name."""
    p = F.replace(name, F.lit("\\"), F.lit("/"))
    return (
        F.when(name.isNull() | ~name.rlike(r"\S"), "blank")
        .when(name.rlike(r"^([/\\]|[A-Za-z]:)"), "rooted")
        .when(F.exists(F.split(p, "/"), lambda s: s.isin(".", "..", "")), "segment")
    )


def canonical(name: Column) -> Column:
    """A good logical name with forward slashes; null for one that is refused."""
    return F.when(name_error(name).isNull(), F.replace(name, F.lit("\\"), F.lit("/")))


def relative(path: Column) -> Column:
    """The path with . and .. resolved; null when it is rooted or leaves its base."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        F.split(p, "/"),
        start,
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(~p.rlike(r"^(/|[A-Za-z]:)") & ~F.array_contains(folded, "..") & (F.size(folded) > 0), F.array_join(folded, "/"))


def is_disc_image(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(iso|img)$")


def is_proof_image(name: Column) -> Column:
    return F.lower(name).rlike(r"(\.jpg|jpeg|\.png|\.bmp|\.gif)$")
