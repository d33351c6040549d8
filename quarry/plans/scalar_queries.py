"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import names, scalars
from quarry.plans.tables import Registry, table

R = Registry()


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, path): a volume path for each part, within the folder of its size."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stem = F.concat(F.lit("CD"), F.col("p_size").cast("string"), F.when(k % 2 == 0, "\\").otherwise("/"), F.lit("rls"), (k % 7).cast("string"))
    number = F.when(k % 11 == 0, 99).otherwise(k % 100)
    two, three = F.lpad(number.cast("string"), 2, "0"), F.lpad(number.cast("string"), 3, "0")
    tails = [F.lit(".rar"), F.concat(F.lit(".r"), two), F.concat(F.lit(".s"), two), F.concat(F.lit(".part"), two, F.lit(".rar")), F.concat(F.lit("."), three), F.concat(F.lit(".R"), two), F.concat(F.lit(".part"), number.cast("string"), F.lit(".rar")), F.lit(".txt"), F.concat(F.lit(".part"), three, F.lit(".RAR")), F.concat(F.lit(".y"), two)]
    tail = F.element_at(F.array(*tails), (k % len(tails)).cast("int") + 1)
    return part.select("p_partkey", F.concat(stem, tail).alias("path"))


VOLUMES_SQL = """v AS (SELECT p_partkey, 'CD' || p_size || CASE WHEN k % 2 = 0 THEN chr(92) ELSE '/' END || 'rls' || (k % 7) ||
  CASE k % 10 WHEN 0 THEN '.rar' WHEN 1 THEN '.r' || two WHEN 2 THEN '.s' || two WHEN 3 THEN '.part' || two || '.rar' WHEN 4 THEN '.' || three
  WHEN 5 THEN '.R' || two WHEN 6 THEN '.part' || n || '.rar' WHEN 7 THEN '.txt' WHEN 8 THEN '.part' || three || '.RAR' ELSE '.y' || two END AS path
  FROM (SELECT *, lpad(CAST(n AS VARCHAR), 2, '0') AS two, lpad(CAST(n AS VARCHAR), 3, '0') AS three
    FROM (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 99 ELSE p_partkey % 100 END AS n FROM part)))"""
LAST = r"regexp_extract(path, '[^/\\]*$')"


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, {LAST} AS segment FROM v")
def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.last_segment(F.col("path")).alias("segment"))


BASE = rf"CASE WHEN regexp_matches({LAST}, '(?i)\.part[0-9]+\.rar$') THEN regexp_replace({LAST}, '(?i)\.part[0-9]+\.rar$', '') ELSE regexp_replace({LAST}, '\.[^.]*$', '') END"


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, {BASE} AS base FROM v")
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.base_name(names.last_segment(F.col("path"))).alias("base"))


KEY = rf"regexp_replace(replace(path, chr(92), '/'), '[^/]*$', '') || {BASE}"


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, {KEY} AS set_key FROM v")
def set_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.set_key(F.col("path")).alias("set_key"))


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, regexp_matches(path, '(?i)\.(rar|[a-z][0-9][0-9]|[0-9][0-9][0-9])$') AS is_volume FROM v")
def is_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.is_volume(F.col("path")).alias("is_volume"))


ORDER_SQL = r"""coalesce(TRY_CAST(nullif(regexp_extract(lower(path), '\.part([0-9]+)\.rar', 1), '') AS INTEGER),
  CASE WHEN regexp_matches(path, '(?i)\.rar$') THEN -1 WHEN regexp_matches(path, '(?i)\.[a-z][0-9][0-9]$')
  THEN (ascii(lower(substr(path, length(path) - 2, 1))) - 114) * 100 + CAST(right(path, 2) AS INTEGER)
  WHEN regexp_matches(path, '\.[0-9][0-9][0-9]$') THEN CAST(right(path, 3) AS INTEGER) ELSE 2147483647 END)"""


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, {ORDER_SQL} AS volume_order FROM v")
def volume_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.volume_order(F.col("path")).alias("volume_order"))


@R.add(rf"""WITH {VOLUMES_SQL}, e AS (SELECT *, regexp_extract(path, '\.[^.]+$') AS ext FROM v), s AS (SELECT *, substr(path, 1, length(path) - length(ext)) AS stem FROM e)
SELECT p_partkey, CASE WHEN ext = '.rar' THEN stem || '.r00' WHEN ext = '.RAR' THEN stem || '.R00'
  WHEN regexp_matches(ext, '^\.[r-zR-Z][0-9][0-9]$') THEN stem || '.' || CASE WHEN right(ext, 2) = '99' THEN chr(ascii(substr(ext, 2, 1)) + 1) || '00'
    ELSE substr(ext, 2, 1) || lpad(CAST(CAST(right(ext, 2) AS INTEGER) + 1 AS VARCHAR), 2, '0') END
  WHEN regexp_matches(ext, '^\.[0-9]+$') THEN stem || '.' || lpad(CAST(CAST(substr(ext, 2) AS INTEGER) + 1 AS VARCHAR), CAST(greatest(length(ext) - 1, length(CAST(CAST(substr(ext, 2) AS INTEGER) + 1 AS VARCHAR))) AS INTEGER), '0') END AS next_old,
  CASE WHEN regexp_matches(path, '(?i)\.part[0-9]+\.rar$') THEN regexp_replace(path, '(?i)[0-9]+\.rar$', '') ||
    lpad(CAST(n + 1 AS VARCHAR), CAST(greatest(length(d), length(CAST(n + 1 AS VARCHAR))) AS INTEGER), '0') || right(path, 4) END AS next_new
FROM (SELECT *, TRY_CAST(d AS INTEGER) AS n FROM (SELECT *, regexp_extract(path, '(?i)\.part([0-9]+)\.rar$', 1) AS d FROM s))""")
def next_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir).select("p_partkey", names.next_old_volume(F.col("path")).alias("next_old"), names.next_new_volume(F.col("path")).alias("next_new"))


@R.add(rf"WITH {VOLUMES_SQL} SELECT p_partkey, unnest(['.part02.rar', '.part002.rar', '.part2.rar', '.r00']) AS tail, 'out/' || {BASE} || unnest(['.part02.rar', '.part002.rar', '.part2.rar', '.r00']) AS candidate FROM v")
def second_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _volumes(spark, sf_dir).withColumn("base", names.base_name(names.last_segment(F.col("path"))))
    rows = rows.select("p_partkey", "base", F.explode(names.second_volumes(F.lit("out"), F.col("base"))).alias("candidate"))
    return rows.select("p_partkey", F.substring(F.col("candidate"), F.length("base") + 5, F.length("candidate")).alias("tail"), "candidate")


@R.add(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(replace(trim('./' || url || '/'), chr(92), '/'), '^(\./)+', ''), '^/+|/+$', '', 'g') AS x FROM pages)
SELECT page_id, CASE WHEN x <> '' AND NOT list_contains(string_split(x, '/'), '.') AND NOT list_contains(string_split(x, '/'), '..') THEN x END AS path FROM p""")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", names.normal_path(F.concat(F.lit("./"), "url", F.lit("/"))).alias("path"))


NAME = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '/') WHEN 2 THEN '/' || url WHEN 3 THEN replace(replace(url, '://', '_'), '/', chr(92)) ELSE 'C:' || url END"


def _names() -> Column:
    url, k = F.col("url"), F.col("page_id") % 5
    dashed = F.replace(F.replace(url, F.lit("://"), F.lit("_")), F.lit("/"), F.lit("\\"))
    return F.when(k == 0, url).when(k == 1, F.replace(url, F.lit("://"), F.lit("/"))).when(k == 2, F.concat(F.lit("/"), url)).when(k == 3, dashed).otherwise(F.concat(F.lit("C:"), url))


@R.add(rf"""WITH n AS (SELECT page_id, {NAME} AS name FROM pages), e AS (SELECT *, CASE WHEN name IS NULL OR NOT regexp_matches(name, '\S') THEN 'blank' WHEN regexp_matches(name, '^([/\\]|[A-Za-z]:)') THEN 'rooted'
  WHEN len(list_intersect(string_split(replace(name, chr(92), '/'), '/'), ['.', '..', ''])) > 0 THEN 'segment' END AS error FROM n)
SELECT page_id, error, CASE WHEN error IS NULL THEN replace(name, chr(92), '/') END AS name FROM e""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("name", _names())
    return pages.select("page_id", names.name_error(F.col("name")).alias("error"), names.canonical(F.col("name")).alias("name"))


@R.add(r"SELECT page_id, regexp_extract(url, '[^/\\]*$') AS segment FROM pages")
def last_url_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.last_segment(F.col("url")).alias("segment"))


@R.add("""SELECT o_orderkey, CAST(round(o_totalprice * 100000) AS BIGINT) AS size, floor(log2(greatest(CAST(round(o_totalprice * 100000) AS BIGINT) - 1, 1)) / 10) AS steps FROM orders""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that human_size picks, as its power of 1024 (the text itself is unit-tested)."""
    size = F.round(F.col("o_totalprice") * 100000).cast("long")
    text = scalars.human_size(size)
    unit = F.element_at(F.split(text, " "), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), (F.array_position(F.array(*map(F.lit, scalars.UNITS)), unit) - 1).cast("double").alias("steps"))


TOOLS = ("winrar-", "rarlinux-x64-", "rarlinux-", "rarosx-", "wrar-", "tool-")


@R.add("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'winrar-' WHEN 1 THEN 'rarlinux-x64-' WHEN 2 THEN 'rarlinux-' WHEN 3 THEN 'rarosx-' WHEN 4 THEN 'wrar-' ELSE 'tool-' END ||
  CASE WHEN p_partkey % 2 = 0 THEN CAST(20 + p_partkey % 700 AS VARCHAR) ELSE (p_partkey % 7 + 1) || '.' || (p_partkey % 10) || '.0' END || CASE WHEN p_partkey % 3 = 0 THEN '-beta1' ELSE '' END AS name,
  CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 2 = 0 THEN 20 + p_partkey % 700 ELSE (p_partkey % 7 + 1) * 100 + (p_partkey % 10) * 10 END AS n FROM part)
SELECT p_partkey, name, CASE WHEN n < 100 THEN n * 10 ELSE n END AS version, CASE WHEN n IS NOT NULL THEN CASE WHEN p_partkey % 3 = 0 THEN 'beta1' ELSE '' END END AS tag,
  CASE WHEN n IS NULL THEN NULL WHEN (CASE WHEN n < 100 THEN n * 10 ELSE n END) < 500 THEN 'RAR4' WHEN (CASE WHEN n < 100 THEN n * 10 ELSE n END) < 700 THEN 'RAR5' ELSE 'RAR7' END AS format FROM t""")
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = F.when(k % 2 == 0, (20 + k % 700).cast("string")).otherwise(F.concat((k % 7 + 1).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(".0")))
    name = F.concat(F.element_at(F.array(*map(F.lit, TOOLS)), (k % 6).cast("int") + 1), number, F.when(k % 3 == 0, "-beta1").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    version = scalars.version(F.col("name"))
    return rows.select("p_partkey", "name", version.alias("version"), scalars.version_tag(F.col("name")).alias("tag"), scalars.archive_format(version).alias("format"))


@R.add("""SELECT l_orderkey, l_linenumber, CASE m WHEN 0 THEN 'Store' WHEN 1 THEN 'Fastest' WHEN 2 THEN 'Fast' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Good' WHEN 5 THEN 'Best' ELSE 'Unknown (0x' || lpad(upper(to_hex(m)), 2, '0') || ')' END AS method,
  CASE h WHEN 0 THEN 'MS-DOS' WHEN 1 THEN 'OS/2' WHEN 2 THEN 'Windows' WHEN 3 THEN 'Unix' WHEN 4 THEN 'Mac OS' WHEN 5 THEN 'BeOS' ELSE 'Unknown (' || h || ')' END AS host,
  CASE v WHEN 50 THEN 'RAR 5.0' ELSE 'RAR ' || (v // 10) || '.' || (v % 10) END AS version
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 8 AS m, l_suppkey % 8 AS h, CAST(l_quantity AS INTEGER) AS v FROM lineitem)""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.method_name(q % 8).alias("method"), scalars.host_name(F.col("l_suppkey") % 8).alias("host"), scalars.version_name(q).alias("version"))


@R.add("SELECT l_orderkey, l_linenumber, [64, 128, 256, 512, 1024, 2048, 4096, 0][CAST(((l_partkey & 224) >> 5) + 1 AS INTEGER)] AS dictionary, (l_partkey & 224) = 224 AS is_directory FROM lineitem")
def dict_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.dictionary_size(F.col("l_partkey")).alias("dictionary"), scalars.is_directory(F.col("l_partkey")).alias("is_directory"))


@R.add("""WITH d AS (SELECT o_orderkey, o_custkey * 2654435 % 4294967296 AS n FROM orders), b AS (SELECT *, (n >> 25) & 127 AS y, (n >> 21) & 15 AS mo, (n >> 16) & 31 AS d, (n >> 11) & 31 AS h, (n >> 5) & 63 AS mi, (n & 31) * 2 AS s FROM d)
SELECT o_orderkey, n AS dos, CASE WHEN n <> 0 AND s < 60 THEN strftime(try_strptime((1980 + y) || '-' || mo || '-' || d || ' ' || h || ':' || mi || ':' || s, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS decoded FROM b""")
def dos_date_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") * 2654435 % 4294967296
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("dos"), F.date_format(scalars.dos_time(n), "yyyy-MM-dd HH:mm:ss").alias("decoded"))


@R.add("SELECT o_orderkey, ((year(o_orderdate) - 1980) << 25) + (month(o_orderdate) << 21) + (day(o_orderdate) << 16) + (hour(o_orderdate) << 11) + (minute(o_orderdate) << 5) + second(o_orderdate) // 2 AS dos FROM orders")
def dos_date_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.to_dos(F.col("o_orderdate")).alias("dos"))


@R.add("SELECT event_id, (epoch_us(ts) % 2000000) >= 1000000 AS round_up, (epoch_us(ts) % 1000000) * 10 AS ticks FROM events")
def time_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", scalars.time_fraction(micros).alias("f")).select("event_id", "f.round_up", "f.ticks")


@R.add("SELECT l_orderkey, l_linenumber, l_orderkey * 1000003 AS value, l_orderkey * 1000003 AS decoded, CASE WHEN v <= 126 THEN 1 WHEN v <= 16382 THEN 2 WHEN v <= 2097150 THEN 3 WHEN v <= 268435454 THEN 4 WHEN v <= 34359738366 THEN 5 WHEN v <= 4398046511102 THEN 6 ELSE 7 END AS n_bytes FROM (SELECT *, l_orderkey * 1000003 AS v FROM lineitem)")
def vint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 1000003).alias("value")).withColumn("code", scalars.vint(F.col("value")))
    return rows.select("l_orderkey", "l_linenumber", "value", scalars.unvint(F.col("code")).alias("decoded"), (F.length("code") / 2).cast("int").alias("n_bytes"))


@R.add("SELECT l_orderkey, l_linenumber, ((l_orderkey & 127) + ((l_orderkey >> 7 & 127) << 8) + ((l_orderkey >> 14 & 127) << 16) + ((l_orderkey >> 21 & 127) << 24)) AS code, l_orderkey AS decoded FROM lineitem")
def syncsafe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.sync_safe(F.col("l_orderkey")).alias("code"))
    return rows.withColumn("decoded", scalars.from_sync_safe(F.col("code")))


@R.add("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def sha1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


#: CRC-32 byte by byte: the table of 256 remainders comes from its rule, eight steps of one bit each.
CRC_SQL = """WITH t AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS rest FROM (SELECT unnest(range(0, 256)) AS n)),
    b AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) END AS bytes FROM documents)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN printf('%08x', xor(list_reduce(bytes, lambda c, x: xor(c // 256, rest[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)) END AS crc32 FROM b, t"""


@R.add(CRC_SQL)
def crc32_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.crc_text(F.encode("text", "UTF-8")).alias("crc32"))


@R.add("SELECT item_id, hex(encode(text)) AS hex_upper, lower(hex(encode(text))) AS hex_lower FROM benchmark")
def hex_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.hex(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "benchmark").select("item_id", code.alias("hex_upper"), F.lower(code).alias("hex_lower"))


@R.add("SELECT o_orderkey, CASE WHEN o_custkey % 6 = 5 THEN '-ma4' ELSE '' END AS forced, v >= 600 AND v < 700 AND o_custkey % 3 = 0 AND (f = 'RAR4' OR o_custkey % 6 <> 1) AS skip FROM (SELECT *, CASE WHEN o_custkey % 6 = 5 THEN 'RAR4' WHEN v < 500 THEN 'RAR4' WHEN v < 700 THEN 'RAR5' ELSE 'RAR7' END AS f FROM (SELECT *, 300 + o_orderkey % 500 AS v FROM orders))")
def skip_known_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    none = F.array().cast("array<string>")
    args = F.concat(F.when(c % 3 == 0, F.array(F.lit("-tsm4"), F.lit("-tsc-"))).otherwise(none), F.when(c % 6 == 1, F.array(F.lit("-ma5"))).otherwise(none), F.when(c % 6 == 5, F.array(F.lit("-ma4"))).otherwise(none))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (300 + F.col("o_orderkey") % 500).alias("v"), args.alias("args"))
    form = scalars.archive_format(F.col("v"), F.col("args"))
    return rows.select("o_orderkey", F.when(c % 6 == 5, "-ma4").otherwise("").alias("forced"), scalars.known_bad(F.col("v"), form, F.col("args")).alias("skip"))


@R.add("""SELECT p_partkey, trim(regexp_extract(line, '^(.*[^ ]) +[^ ]*$', 1)) AS by_last_space, CASE WHEN len(string_split(line, ' ')) >= 2 AND length(string_split(line, ' ')[2]) = 8 THEN string_split(line, ' ')[1] END AS by_first_space
FROM (SELECT p_partkey, p_name || '.r' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' ' || lpad(lower(to_hex(p_partkey * 7919)), 8, '0') AS line FROM part)""")
def sfv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.sources import manifests

    k = F.col("p_partkey")
    line = F.concat("p_name", F.lit(".r"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad(F.lower(F.hex(k * 7919)), 8, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return rows.select("p_partkey", manifests.entry_name(F.col("line")).alias("by_last_space"), manifests.entry(F.col("line"))["name"].alias("by_first_space"))


@R.add(r"SELECT event_id, TRY_CAST(nullif(regexp_extract(coalesce(props, ''), '([0-9]{1,3})%', 1), '') AS INTEGER) AS percent, regexp_matches(coalesce(props, ''), 'OK\s*$') AS ok FROM events")
def progress_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.coalesce("props", F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(props, r"([0-9]{1,3})%", 1).try_cast("int").alias("percent"), props.rlike(r"OK\s*$").alias("ok"))
