"""Field comparison, gates, reconciliation, placement and arguments over whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import chains, diff, extents, match, resolve
from quarry.plans.relational_queries import CRCS, _crcs
from quarry.plans.tables import Registry, table

R = Registry()


def _blocks(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Orders as blocks of fields; every third lacks its last field, and keys are moved by shift."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    values = [("Status", status), ("Priority", priority), ("Header CRC", F.col("o_custkey").cast("string")), ("Year", F.year("o_orderdate").cast("string"))]
    rows = F.array(*(F.struct(F.lit(i).alias("field_no"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(values)))
    kept = F.when(F.col("o_orderkey") % 3 == 0, F.slice(rows, 1, 3)).otherwise(rows)
    return orders.select((F.col("o_orderkey") + shift).alias("o_orderkey"), (F.col("o_custkey") % 2).alias("data_size"), F.inline(kept))


FIELDS = """f AS (SELECT o_orderkey AS k, o_custkey % 2 AS data_size, x.* FROM orders, LATERAL (VALUES (0, 'Status', o_orderstatus), (1, 'Priority', o_orderpriority), (2, 'Header CRC', CAST(o_custkey AS VARCHAR)),
(3, 'Year', CAST(year(o_orderdate) AS VARCHAR))) AS x(field_no, name, value) WHERE o_orderkey % 3 <> 0 OR field_no < 3),
b AS (SELECT k, max(data_size) AS s FROM f GROUP BY 1), both_sides AS (SELECT l.k, l.s <> r.s AS sizes_differ FROM b l JOIN b r ON l.k = r.k + 1),
p AS (SELECT k, field_no, l.name AS l_name, r.name AS r_name, l.value AS l_value, r.value AS r_value FROM f l FULL JOIN (SELECT k + 1 AS k, field_no, name, value FROM f) r USING (k, field_no) WHERE k IN (SELECT k FROM both_sides))"""


@R.add(f"""WITH {FIELDS} SELECT k AS o_orderkey, field_no, coalesce(l_name, r_name) AS property, coalesce(l_value, 'N/A') AS left_value, coalesce(r_value, 'N/A') AS right_value
FROM p WHERE coalesce(l_value, 'N/A') <> coalesce(r_value, 'N/A') AND coalesce(l_name, r_name) NOT IN ('Header CRC', 'CRC32')""")
def field_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's fields against those of the order with the key before it."""
    return diff.field_pairs(_blocks(spark, sf_dir, 0), _blocks(spark, sf_dir, 1), ["o_orderkey"])


@R.add(f"WITH {FIELDS} SELECT k AS o_orderkey, bool_or(sizes_differ OR coalesce(l_value, '') <> coalesce(r_value, '')) AS differs FROM p JOIN both_sides USING (k) GROUP BY 1")
def quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.quick_check(_blocks(spark, sf_dir, 0), _blocks(spark, sf_dir, 1), ["o_orderkey"])


@R.add("""WITH p AS (SELECT l.o_orderkey, l.o_orderstatus AS lk, r.o_orderstatus AS rk, l.o_custkey AS lv, r.o_custkey AS rv FROM orders l JOIN orders r ON l.o_orderkey = r.o_orderkey + 1)
SELECT o_orderkey, 'File Type' AS property, lk || ' file' AS left_value, rk || ' file' AS right_value FROM p WHERE lk <> rk OR lk NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'Customer', CAST(lv AS VARCHAR), CAST(rv AS VARCHAR) FROM p WHERE lk = rk AND lk = 'F' AND lv <> rv
UNION ALL SELECT o_orderkey, 'Parity', CAST(lv % 2 AS VARCHAR), CAST(rv % 2 AS VARCHAR) FROM p WHERE lk = rk AND lk = 'O' AND lv % 2 <> rv % 2""")
def compare_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the ones before them, by status as their kind; P has no comparison of its own."""
    orders = table(spark, sf_dir, "orders")
    side = lambda s, shift: orders.select((F.col("o_orderkey") + shift).alias("o_orderkey"), F.col("o_orderstatus").alias(f"{s}_kind"), F.col("o_custkey").alias(f"{s}_customer"))
    typed = lambda s: F.concat(f"{s}_kind", F.lit(" file")).alias(f"{s}_type")

    def by(name: str, value) -> Column:
        left, right = value(F.col("left_customer")), value(F.col("right_customer"))
        return F.when(left != right, F.array(F.struct(F.lit(name).alias("property"), left.cast("string").alias("left_value"), right.cast("string").alias("right_value"))))

    pairs = side("left", 0).join(side("right", 1), "o_orderkey").select("*", typed("left"), typed("right"))
    return diff.compared(pairs, ["o_orderkey"], {"F": by("Customer", lambda c: c), "O": by("Parity", lambda c: c % 2)})


@R.add("""WITH v AS (SELECT l_orderkey AS g, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS ord, 'V' || l_partkey % 7 AS name, 's' || l_suppkey % 9 AS source FROM lineitem),
s AS (SELECT o_orderkey AS g, 'v' || o_custkey % 7 AS name, 'S' || o_custkey % 9 AS source FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, source ORDER BY ord) AS n FROM v) WHERE n = 1 AND (g, source) NOT IN (SELECT g, lower(source) FROM s))
SELECT g AS set_key, ord, name, source, row_number() OVER (PARTITION BY g, lower(name) ORDER BY ord) > 1 OR (g, lower(name)) IN (SELECT g, name FROM s) AS conflict FROM k""")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as an order's volumes, the order as its stored file."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    text = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    order = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    volumes = line.select(F.col("l_orderkey").alias("set_key"), order.alias("ord"), text("V", "l_partkey", 7).alias("name"), text("s", "l_suppkey", 9).alias("source"))
    stored = orders.select(F.col("o_orderkey").alias("set_key"), text("v", "o_custkey", 7).alias("name"), text("S", "o_custkey", 9).alias("source"))
    return match.reconciled(volumes, stored, ["set_key"])


@R.add("""WITH p AS (SELECT doc_id, sha1(text) AS digest FROM documents), k AS (SELECT DISTINCT sha1(text) AS digest FROM documents WHERE doc_id % 10 = 0), d AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id) > 1 AS is_duplicate, digest IN (SELECT digest FROM k) AS matched FROM p)
SELECT doc_id, digest, is_duplicate, matched, matched OR NOT is_duplicate AS keep FROM d""")
def first_volume_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as produced files; the digests of every tenth, in upper case, are known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("digest"))
    known = docs.where("doc_id % 10 = 0").select(F.upper("digest").alias("digest"))
    return match.first_volume_gate(docs, known, "digest", "doc_id", delete_repeated=True).select("doc_id", "digest", "is_duplicate", "matched", "keep")


@R.add(f"""WITH {CRCS}, m AS (SELECT l_orderkey, position, name, e.crc AS expected, p.crc AS actual FROM p JOIN e USING (l_orderkey, position) WHERE lower(p.crc) <> lower(e.crc)),
x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY position) = 1),
n AS (SELECT l_orderkey, coalesce(a, 0) AS a, b FROM (SELECT l_orderkey, count(*) AS b FROM e GROUP BY 1) LEFT JOIN (SELECT l_orderkey, count(*) AS a FROM p GROUP BY 1) USING (l_orderkey))
SELECT l_orderkey, a = b AND x.name IS NULL AS passes, CASE WHEN a <> b THEN 'produced ' || a || ' volume(s), expected ' || b WHEN x.name IS NOT NULL THEN x.name || ' CRC mismatch (expected ' || x.expected || ', got ' || x.actual || ')' END AS reason FROM n LEFT JOIN x USING (l_orderkey)""")
def full_set_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.full_set_gate(*_crcs(spark, sf_dir), ["l_orderkey"])


@R.add("""SELECT o.o_orderkey, o.o_custkey AS track_no, o.o_custkey % 4 AS signature_size, coalesce(f.at, 0) AS match_offset FROM orders o LEFT JOIN
(SELECT l_orderkey, min(nullif(l_partkey % 3, 0)) AS at FROM lineitem GROUP BY 1) f ON o.o_orderkey = f.l_orderkey""")
def verified_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tracks = orders.select("o_orderkey", F.col("o_custkey").alias("track_no"), (F.col("o_custkey") % 4).alias("signature_size"))
    found = line.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 3).alias("offset")).join(tracks.select("o_orderkey", "track_no"), "o_orderkey")
    return match.verified_tracks(tracks, found, ["o_orderkey"]).select("o_orderkey", "track_no", "signature_size", "match_offset")


PIECES = """p AS (SELECT l_orderkey, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS ord, CASE WHEN l_partkey % 3 > 0 THEN l_partkey END AS crc, l_suppkey % 2 = 0 AS split_after,
CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS BIGINT) END AS mtime, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS ctime FROM lineitem)"""


@R.add(f"""WITH {PIECES} SELECT l_orderkey, coalesce(first(mtime ORDER BY crc IS NULL, split_after, ord) FILTER (crc IS NOT NULL AND w), first(mtime ORDER BY ord) FILTER (crc IS NOT NULL AND c), first(mtime ORDER BY ord) FILTER (mtime IS NOT NULL)) AS mtime,
coalesce(first(ctime ORDER BY crc IS NULL, split_after, ord) FILTER (crc IS NOT NULL AND w), first(ctime ORDER BY ord) FILTER (crc IS NOT NULL AND c), first(ctime ORDER BY ord) FILTER (ctime IS NOT NULL)) AS ctime
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY crc IS NULL, split_after, ord) = 1 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY crc IS NULL, ord) = 1 AS c FROM p) GROUP BY 1""")
def split_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pieces of an order's entry."""
    li = table(spark, sf_dir, "lineitem")
    pieces = li.select(
        "l_orderkey", (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("crc"),
        (F.col("l_suppkey") % 2 == 0).alias("split_after"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("long")).alias("mtime"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("ctime"),
    )
    return resolve.resolve_times(pieces, ["l_orderkey"], ["mtime", "ctime"])


@R.add("SELECT l_orderkey, l_linenumber, p_brand AS crc, p_size AS mtime FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 2 = 0")
def set_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of parts of even keys, by names in another case."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    files = li.select("l_orderkey", "l_linenumber", F.concat(F.lit("File"), F.col("l_partkey").cast("string")).alias("name"))
    facts = part.select(F.concat(F.lit("FILE"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("crc"), F.col("p_size").alias("mtime"))
    return resolve.set_facts(files, facts).drop("name")


@R.add("""WITH f AS (SELECT l_orderkey, l_returnflag AS k, first(l_partkey ORDER BY l_partkey * 1000000 + l_suppkey * 100 + l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) AS entries FROM f GROUP BY 1""")
def first_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber"))
    shown = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return resolve.as_map(li, ["l_orderkey"], "l_returnflag", "l_partkey", "ord").select("l_orderkey", F.array_join(shown, ",").alias("entries"))


@R.add("""WITH ok AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 5)) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM ok)""")
def patched_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the orders of which all lines are patched: quantities over 5."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return resolve.all_or_none(li, ["l_orderkey"], F.col("l_quantity") > 5).drop("l_quantity")


def _created(key: Column) -> Column:
    ending = F.element_at(F.array(*map(F.lit, (".exe", ".part01.rar", ".part1.rar", ".rar", ".zip"))), (key % 5 + 1).cast("int"))
    return F.concat(F.lit("out/v"), key.cast("string"), ending)


@R.add("""SELECT 'out/v' || p_partkey || '.exe' AS path, 'out/v' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.part01.rar' WHEN 2 THEN CASE WHEN p_size > 25 THEN '.part01.rar' ELSE '.part1.rar' END WHEN 3 THEN '.rar' END AS found FROM part""")
def created_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one of five endings for each part, and a second one for some."""
    part = table(spark, sf_dir, "part")
    path = lambda e: F.concat(F.lit("out/v"), F.col("p_partkey").cast("string"), F.lit(e)).alias("path")
    present = part.select(_created(F.col("p_partkey")).alias("path")).unionByName(part.where("p_partkey % 5 = 2 and p_size > 25").select(path(".part01.rar")))
    return chains.created_files(part.select(path(".exe")), present)


@R.add("""WITH r AS (SELECT l_orderkey, 'a/' || l_partkey AS source, CASE WHEN l_suppkey % 4 = 0 THEN 'A/' || l_partkey ELSE 'b/' || l_partkey END AS dest FROM lineitem),
w AS (SELECT l_orderkey, lower(dest) AS d, count(*) AS n, bool_or(lower(source) <> lower(dest) AND lower(dest) IN (SELECT 'b/' || p_partkey FROM part WHERE p_partkey % 10 = 0)) AS taken FROM r GROUP BY 1, 2),
b AS (SELECT l_orderkey, bool_or(n > 1 OR taken) AS bad FROM w GROUP BY 1)
SELECT l_orderkey, source, dest, CASE WHEN bad THEN 'refused' WHEN lower(source) = lower(dest) THEN 'stay' ELSE 'move' END AS action FROM r JOIN b USING (l_orderkey)""")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as moves; targets of every tenth part are taken."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    at = lambda folder, c: F.concat(F.lit(folder), F.col(c).cast("string"))
    plan = li.select("l_orderkey", at("a/", "l_partkey").alias("source"), F.when(F.col("l_suppkey") % 4 == 0, at("A/", "l_partkey")).otherwise(at("b/", "l_partkey")).alias("dest"))
    return chains.placement(plan, part.where("p_partkey % 10 = 0").select(at("b/", "p_partkey").alias("path")), ["l_orderkey"])


@R.add("""SELECT p_partkey, '-cfg- a -r -m' || p_size % 6 || ' -md64 -zc.txt' || CASE WHEN p_size * 16 BETWEEN 550 AND 699 THEN ' -ma4' ELSE '' END || CASE WHEN p_size * 16 >= 320 THEN ' -tsc- -tsa-' ELSE '' END AS args FROM part""")
def comment_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    made = scalars.comment_arguments(F.col("p_size") * 16, F.concat(F.lit("-m"), (F.col("p_size") % 6).cast("string")), F.lit("-md64"), F.lit("c.txt"))
    return part.select("p_partkey", F.array_join(made, " ").alias("args"))


@R.add("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN 24970 + p_size + length('./' || replace(p_type, '\\', '/')) + CASE WHEN contains(p_type, ' ') THEN 2 ELSE 0 END <= 25000 THEN './' || p_type WHEN p_partkey % 4 = 1 THEN NULL ELSE '@l.lst' END AS tail,
CASE WHEN p_partkey % 4 > 1 AND 24970 + p_size + length('./' || p_type) + CASE WHEN contains(p_type, ' ') THEN 2 ELSE 0 END > 25000 THEN p_type END AS list_text
FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 1 THEN 'é' || p_type ELSE p_type END AS p_type FROM part)""")
def input_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name for each part: none for every fourth, not ASCII for another fourth; some are too long."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("é"), "p_type")).otherwise(F.col("p_type"))
    names = F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(name))
    made = scalars.input_operands(names, 24970 + F.col("p_size"), F.lit("l.lst"))
    return part.select("p_partkey", made.alias("_o")).select("p_partkey", F.array_join("_o.tail", " ").alias("tail"), "_o.list_text")


@R.add("SELECT l_orderkey, sha1(string_agg('<' || l_partkey || '>', '' ORDER BY l_partkey * 1000000 + l_suppkey * 100 + l_linenumber)) AS digest FROM lineitem GROUP BY 1")
def tracks_in_media_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of an order's lines as tracks, put together by their offsets."""
    li = table(spark, sf_dir, "lineitem")
    offset = (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("match_offset")
    pieces = li.select("l_orderkey", offset, F.encode(F.concat(F.lit("<"), F.col("l_partkey").cast("string"), F.lit(">")), "UTF-8").alias("data"))
    return extents.assemble(pieces, "l_orderkey", order="match_offset").select("l_orderkey", F.sha1("data").alias("digest"))
