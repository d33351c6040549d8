"""Checksum manifests: SFV in its two grammars, SHA-1 lists, and language lines of subtitle indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT = r"^\s*[;#:]"


def entry(line: Column) -> Column:
    """(name, crc) of an SFV line: first two tokens between spaces, the second of 8 characters; else null."""
    tokens = F.filter(F.split(F.trim(line), " "), lambda t: t != "")
    crc = F.try_element_at(tokens, F.lit(2))
    return F.when(~line.rlike(COMMENT) & (F.length(crc) == 8), F.struct(F.try_element_at(tokens, F.lit(1)).alias("name"), F.lower(crc).alias("crc")))


def entry_name(line: Column) -> Column:
    """What stands before the last space of a line that is no ; comment; else null."""
    trimmed = F.trim(line)
    found = F.trim(F.regexp_extract(trimmed, r"^(.+) \S*$", 1))
    return F.when(~F.startswith(trimmed, F.lit(";")) & (found != ""), found)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under a path; whole files, so for small ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def numbered_lines(rows: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, content), as Latin-1; blank lines go, but count."""
    lines = rows.select("path", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\r\n|\r|\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def read_sfv(spark: SparkSession, path: str, tolerant: bool = True, glob: str = "*.sfv") -> DataFrame:
    """(path, line_no, name, algo, digest).  Strict: a line that is neither entry nor comment is an error."""
    rows = numbered_lines(files(spark, path, glob)).where(~F.col("line").rlike(COMMENT)).withColumn("e", entry(F.col("line")))
    if tolerant:
        rows = rows.where("e is not null")
    name = F.coalesce("e.name", F.raise_error(F.concat(F.lit("not an SFV line: "), "line")))
    return rows.select("path", "line_no", name.alias("name"), F.lit("crc32").alias("algo"), F.col("e.crc").alias("digest"))


def read_sha1(spark: SparkSession, path: str, glob: str = "*.sha1") -> DataFrame:
    """(path, line_no, name, algo, digest) of lines with a digest of 40 characters, " *" and a name."""
    rows = numbered_lines(files(spark, path, glob)).withColumn("at", F.split("line", r" \*", 2))
    rows = rows.where((F.size("at") == 2) & (F.length(F.col("at")[0]) == 40))
    return rows.select("path", "line_no", F.trim(F.col("at")[1]).alias("name"), F.lit("sha1").alias("algo"), F.lower(F.col("at")[0]).alias("digest"))


def sha1_lines(manifest: DataFrame) -> DataFrame:
    """(value): the lines of a SHA-1 manifest of (name, digest), sorted by name; write them with write.text."""
    return manifest.orderBy("name").select(F.concat("digest", F.lit(" *"), "name").alias("value"))


def language_lines(text: Column) -> Column:
    """The lines that start with "id: ", joined again."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.startswith(x, F.lit("id: "))), "\n")
