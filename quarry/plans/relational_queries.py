"""Diffs, matches, facts, rules, candidates and extents over whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import candidates as cand
from quarry.operators import diff, edit, extents, match, resolve
from quarry.plans.tables import Registry, table

R = Registry()


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two manifests: documents and pages as they are; documents in lower case, and benchmark items."""
    docs, pages, items = (table(spark, sf_dir, t) for t in ("documents", "pages", "benchmark"))
    sha = lambda c: F.sha1(F.encode(c, "UTF-8")).alias("digest")
    row = lambda kind, key, text: (F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("name"), sha(text), F.length(text).cast("long").alias("size"))
    left = docs.select(*row("doc", "doc_id", "text")).unionByName(pages.select(*row("page", "page_id", "html")))
    right = docs.select(*row("doc", "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")))).unionByName(items.select(*row("item", "item_id", "text")))
    return left, right


MANIFESTS = """l AS (SELECT 'doc/' || doc_id AS name, sha1(text) AS digest, length(text) AS size FROM documents UNION ALL SELECT 'page/' || page_id, sha1(html), length(html) FROM pages),
r AS (SELECT 'doc/' || doc_id AS name, sha1(replace(text, chr(10), ' ')) AS digest, length(text) AS size FROM documents UNION ALL SELECT 'item/' || item_id, sha1(text), length(text) FROM benchmark)"""


@R.add(f"""WITH {MANIFESTS} SELECT name, l.digest AS l_digest, r.digest AS r_digest, l.size AS l_size, r.size AS r_size,
CASE WHEN r.digest IS NULL THEN 'Removed' WHEN l.digest IS NULL THEN 'Added' ELSE 'Modified' END AS diff_type
FROM l FULL JOIN r USING (name) WHERE coalesce(l.digest, '') <> coalesce(r.digest, '') OR coalesce(CAST(l.size AS VARCHAR), '') <> coalesce(CAST(r.size AS VARCHAR), '')""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.keyed_diff(*_manifests(spark, sf_dir), ["name"], ["digest", "size"])


@R.add("SELECT sha1(text) AS digest, min(doc_id) AS doc_id, first(source ORDER BY doc_id) AS source FROM documents GROUP BY sha1(text)")
def stored_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("digest"), "doc_id", "source")
    return diff.first_wins(docs, F.col("digest"), "doc_id")


@R.add("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS position, l_quantity FROM lineitem),
r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey) - 1 AS position, l_quantity FROM lineitem)
SELECT l_orderkey, position, l.l_quantity AS l_quantity, r.l_quantity AS r_quantity, 'Modified' AS diff_type FROM l JOIN r USING (l_orderkey, position) WHERE l.l_quantity <> r.l_quantity""")
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as they stand, against the same lines by quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"))
    a = diff.positioned(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "quantity"])
    b = diff.positioned(rows, ["l_orderkey"], ["quantity", "l_linenumber", "l_partkey", "l_suppkey"])
    return diff.keyed_diff(a, b, ["l_orderkey", "position"], ["quantity"])


@R.add("""WITH l AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS occurrence, l_partkey FROM lineitem),
r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber, l_quantity) - 1 AS occurrence, l_partkey FROM lineitem)
SELECT l_orderkey, l_returnflag, occurrence, l.l_partkey AS l_part, r.l_partkey AS r_part, 'Modified' AS diff_type FROM l JOIN r USING (l_orderkey, l_returnflag, occurrence) WHERE l.l_partkey <> r.l_partkey""")
def occurrence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", F.col("l_partkey").alias("part"))
    a = diff.positioned(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "part", "l_quantity"], "occurrence")
    b = diff.positioned(rows, ["l_orderkey", "l_returnflag"], ["part", "l_linenumber", "l_quantity"], "occurrence")
    return diff.keyed_diff(a, b, ["l_orderkey", "l_returnflag", "occurrence"], ["part"])


@R.add("""WITH p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, o_orderkey + 1 AS k FROM orders)
SELECT o.o_orderkey, x.property, x.left_value, x.right_value FROM orders o JOIN p ON o.o_orderkey = p.k,
LATERAL (VALUES ('o_orderstatus', o.o_orderstatus, p.o_orderstatus), ('o_orderpriority', o.o_orderpriority, p.o_orderpriority), ('o_custkey', CAST(o.o_custkey AS VARCHAR), CAST(p.o_custkey AS VARCHAR))) AS x(property, left_value, right_value)
WHERE x.left_value <> x.right_value""")
def property_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the one with the key before it."""
    orders = table(spark, sf_dir, "orders")
    facts = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return diff.property_rows(orders.select("o_orderkey", *facts), orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), *facts), ["o_orderkey"], facts)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one tree; a customer's element is named by its segment."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r = region.select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ordinal"))
    n = nation.select((F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ordinal"))
    c = customer.select((F.col("c_custkey") + 1000).alias("node_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ordinal"))
    return r.unionByName(n).unionByName(c)


TREE = """t AS (SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, r_regionkey AS ordinal FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, n_nationkey FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_mktsegment, c_custkey FROM customer),
s AS (SELECT node_id, parent_id, '/' || name || CASE WHEN k > 1 THEN '[' || (k - 1) || ']' ELSE '' END AS step FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, name ORDER BY ordinal) AS k FROM t))"""


@R.add(f"WITH {TREE} SELECT c.node_id, coalesce(a.step, '') || coalesce(b.step, '') || c.step AS path FROM s c LEFT JOIN s b ON c.parent_id = b.node_id LEFT JOIN s a ON b.parent_id = a.node_id")
def tree_flatten_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.element_paths(_tree(spark, sf_dir)).select("node_id", "path")


def _crcs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Produced and expected volumes of each order: parts' keys in hex; every 50th part is spoilt, every 40th order lacks its first."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = diff.positioned(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    expected = rows.select("l_orderkey", "position", F.concat(F.lit("v.r"), F.col("position").cast("string")).alias("name"), F.lower(F.hex("l_partkey")).alias("crc"))
    lost = (F.col("l_orderkey") % 40 == 0) & (F.col("position") == 0)
    produced = rows.select("l_orderkey", "position", F.when(lost, None).when(F.col("l_partkey") % 50 == 0, "0").otherwise(F.hex("l_partkey")).alias("crc")).where(F.col("crc").isNotNull())
    return produced, expected


CRCS = """p0 AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS position FROM lineitem),
e AS (SELECT l_orderkey, position, 'v.r' || position AS name, lower(to_hex(l_partkey)) AS crc FROM p0),
p AS (SELECT l_orderkey, position, CASE WHEN l_partkey % 50 = 0 THEN '0' ELSE upper(to_hex(l_partkey)) END AS crc FROM p0 WHERE NOT (l_orderkey % 40 = 0 AND position = 0))"""


@R.add(f"WITH {CRCS} SELECT l_orderkey, position, p.crc AS actual, name, e.crc AS expected, lower(p.crc) = lower(e.crc) AS matches FROM p JOIN e USING (l_orderkey, position)")
def zip_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.zip_verify(*_crcs(spark, sf_dir), ["l_orderkey"])


@R.add(f"""WITH {CRCS}, m AS (SELECT l_orderkey, min(position) FILTER (lower(p.crc) <> lower(e.crc)) AS first_mismatch FROM p JOIN e USING (l_orderkey, position) GROUP BY 1),
n AS (SELECT l_orderkey, coalesce(a, 0) AS n_produced, coalesce(b, 0) AS n_expected FROM (SELECT l_orderkey, count(*) AS a FROM p GROUP BY 1) FULL JOIN (SELECT l_orderkey, count(*) AS b FROM e GROUP BY 1) USING (l_orderkey))
SELECT l_orderkey, n_produced, n_expected, first_mismatch, n_produced <> n_expected AS count_mismatch, n_produced = n_expected AND first_mismatch IS NULL AS all_match FROM n LEFT JOIN m USING (l_orderkey)""")
def zip_first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.zip_result(*_crcs(spark, sf_dir), ["l_orderkey"])


@R.add("""WITH e AS (SELECT o_custkey, lower(regexp_extract('a/' || o_orderpriority, '[^/]*$')) AS k, count(*) AS n FROM orders GROUP BY 1, 2),
a AS (SELECT o_custkey, lower(regexp_extract('b/' || CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'none' ELSE upper(o_orderpriority) END, '[^/]*$')) AS k, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, bool_and(coalesce(e.n, 0) = coalesce(a.n, 0)) AS matches FROM e FULL JOIN a USING (o_custkey, k) GROUP BY 1""")
def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    actual = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderstatus") == "F"), "none").otherwise(F.upper("o_orderpriority"))
    return match.multiset_match(orders.select("o_custkey", F.concat(F.lit("a/"), "o_orderpriority").alias("name")), orders.select("o_custkey", F.concat(F.lit("b/"), actual).alias("name")), ["o_custkey"])


@R.add("""WITH k AS (SELECT 'p/' || p_partkey AS key, p_brand AS crc FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 's/' || s_suppkey, s_name FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a.crc, b.crc) AS crc FROM lineitem LEFT JOIN k a ON a.key = 'p/' || l_partkey LEFT JOIN k b ON b.key = 's/' || l_suppkey WHERE coalesce(a.crc, b.crc) IS NOT NULL""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part where the part is known (even keys), else by supplier."""
    part, supplier, li = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    known = part.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p/"), "p_partkey")).alias("key"), F.col("p_brand").alias("crc")).where(F.col("key").isNotNull())
    known = known.unionByName(supplier.select(F.concat(F.lit("s/"), "s_suppkey").alias("key"), F.col("s_name").alias("crc")))
    items = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("p/"), "l_partkey").alias("a"), F.concat(F.lit("s/"), "l_suppkey").alias("b"))
    return match.lookup_fallback(items, known, "a", "b", "key", "crc").drop("a", "b")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return match.missing(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@R.add("SELECT lower(p_type) AS segment, count(DISTINCT lower(p_brand)) AS n FROM part GROUP BY 1 HAVING count(DISTINCT lower(p_brand)) > 1")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.ambiguous(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("name")))


@R.add("SELECT sha1(text) AS name, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.source_conflicts(table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("name"), "source"))


@R.add("SELECT doc_id, sha1(text) AS digest, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dup_hash_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("digest"))
    return match.seen_before(docs, "digest", "doc_id").select("doc_id", "digest", "is_duplicate")


@R.add("""SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/' || p_type AS set_key, min(p_partkey) AS first_ord, count(*) AS n_volumes FROM part GROUP BY 1""")
def set_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    path = F.concat(folder, F.lit("\\"), "p_type", F.when(F.col("p_partkey") % 2 == 0, ".part01.rar").otherwise(".r07"))
    return resolve.archive_sets(table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_partkey").alias("ord")))


FACTS = "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS INTEGER) END AS size, l_orderkey, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS ord"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 100000000000 + F.col("l_partkey") * 100 + q.cast("long")).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"), F.when(q > 25, q.cast("int")).alias("size"))


@R.add(f"WITH f AS (SELECT {FACTS} FROM lineitem) SELECT l_orderkey, arg_min(flag, ord) FILTER (flag IS NOT NULL) AS flag, arg_min(size, ord) FILTER (size IS NOT NULL) AS size FROM f GROUP BY 1")
def first_non_null_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_non_null(_facts(spark, sf_dir), ["l_orderkey"], ["flag", "size"], "ord")


@R.add(f"WITH f AS (SELECT {FACTS} FROM lineitem) SELECT l_orderkey, arg_max(flag, ord) FILTER (flag IS NOT NULL) AS flag, arg_max(size, ord) FILTER (size IS NOT NULL) AS size FROM f GROUP BY 1")
def last_wins_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.last_non_null(_facts(spark, sf_dir), ["l_orderkey"], ["flag", "size"], "ord")


@R.add(f"WITH f AS (SELECT {FACTS} FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS k FROM f) SELECT l_orderkey, flag, size FROM n WHERE k = 1")
def first_header_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_header(_facts(spark, sf_dir), ["l_orderkey"], ["flag", "size"], "ord")


@R.add("""WITH p AS (SELECT l_suppkey, l_orderkey * 100 + l_linenumber AS ord, CASE WHEN l_returnflag <> 'N' THEN to_hex(l_partkey) END AS crc, l_linestatus = 'O' AS split_after FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY crc IS NULL, split_after, ord, crc) AS n FROM p)
SELECT l_suppkey, crc, CASE WHEN crc IS NOT NULL THEN ord END AS from_ord, m AS n_pieces FROM k JOIN (SELECT l_suppkey, count(*) AS m FROM p GROUP BY 1) USING (l_suppkey) WHERE n = 1""")
def split_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_returnflag") != "N", F.upper(F.hex("l_partkey"))).alias("crc"), (F.col("l_linestatus") == "O").alias("split_after"))
    return resolve.resolve_split(rows, ["l_suppkey"])


@R.add("SELECT l_partkey, mode, n FROM (SELECT l_partkey, l_quantity AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_quantity DESC) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def mode_tie_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.mode_larger(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")


def rules() -> list[tuple[str, str, Column]]:
    return [
        ("Error", "no quantity", F.coalesce(F.col("l_quantity") <= 0, F.lit(True))),
        ("Warning", "deep discount", F.col("l_discount") > 0.08),
        ("Warning", "odd part", F.col("l_partkey") % 97 == 0),
        ("Error", "part and supplier equal", F.col("l_partkey") == F.col("l_suppkey")),
        ("Info", "open line", F.col("l_linestatus") == "O"),
    ]


ISSUES = """i AS (SELECT l_orderkey, l_linenumber, x.severity, x.rule FROM lineitem, LATERAL (VALUES ('Error', 'no quantity', coalesce(l_quantity <= 0, true)), ('Warning', 'deep discount', l_discount > 0.08),
('Warning', 'odd part', l_partkey % 97 = 0), ('Error', 'part and supplier equal', l_partkey = l_suppkey), ('Info', 'open line', l_linestatus = 'O')) AS x(severity, rule, broken) WHERE x.broken)"""


@R.add(f"WITH {ISSUES} SELECT * FROM i")
def verify_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.issues(table(spark, sf_dir, "lineitem"), rules(), ["l_orderkey", "l_linenumber"])


@R.add(f"WITH {ISSUES} SELECT l_orderkey, count(*) FILTER (severity = 'Error') AS n_error, count(*) FILTER (severity = 'Warning') AS n_warning, count(*) FILTER (severity = 'Info') AS n_info, count(*) FILTER (severity = 'Error') = 0 AS valid FROM i GROUP BY 1")
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.verdict(verify_issues(spark, sf_dir), ["l_orderkey"])


FLAGS = [(0x0001, "VOLUME"), (0x0002, "COMMENT"), (0x0004, "LOCK"), (0x0008, "SOLID"), (0x0010, "NEW_NAMING"), (0x0100, "FIRST_VOLUME")]


@R.add("SELECT o_orderkey, x.mask, x.flag, (o_custkey & x.mask) <> 0 AS is_set FROM orders, (VALUES (1, 'VOLUME'), (2, 'COMMENT'), (4, 'LOCK'), (8, 'SOLID'), (16, 'NEW_NAMING'), (256, 'FIRST_VOLUME')) AS x(mask, flag)")
def flag_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.expanded_flags(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", FLAGS).drop("o_custkey")


@R.add("""SELECT p_size AS volume, bool_or(p_type LIKE '%E%') AS has_image, arg_max(p_type LIKE '%E%', p_partkey) AS last_is_image, count(*) > 0 AS has_entries, bool_or(p_retailprice > 1500) AS any_compressed FROM part GROUP BY 1""")
def proof_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_size", "volume")
    return resolve.proof_facts(part, ["volume"], "p_partkey", F.contains("p_type", F.lit("E")), F.col("p_retailprice") > 1500)


SWITCHES = [("-m3", 0, None, None), ("-ma5", 500, 699, "RAR5"), ("-tsc-", 300, None, None), ("-md4096", 200, 599, "RAR4"), ("-qo-", 700, None, "RAR7")]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "part").select((200 + F.col("p_partkey") % 600).cast("int").alias("version")).distinct()
    kind = "set_no int, args array<struct<arg: string, low: int, high: int, only: string>>"
    sets = spark.createDataFrame([(i, SWITCHES[: i + 1]) for i in range(len(SWITCHES))], kind)
    return cand.enumerate_candidates(versions, sets)


CANDIDATES = """v AS (SELECT DISTINCT CAST(200 + p_partkey % 600 AS INTEGER) AS version FROM part), s(set_no) AS (VALUES (0), (1), (2), (3), (4)),
f AS (SELECT version, set_no, CASE WHEN set_no >= 1 THEN 'RAR5' WHEN version < 500 THEN 'RAR4' WHEN version < 700 THEN 'RAR5' ELSE 'RAR7' END AS format FROM v, s),
c AS (SELECT *, list_filter(['-m3', CASE WHEN set_no >= 1 AND version BETWEEN 500 AND 699 AND format = 'RAR5' THEN '-ma5' END, CASE WHEN set_no >= 2 AND version >= 300 THEN '-tsc-' END,
  CASE WHEN set_no >= 3 AND version BETWEEN 200 AND 599 AND format = 'RAR4' THEN '-md4096' END, CASE WHEN set_no >= 4 AND version >= 700 AND format = 'RAR7' THEN '-qo-' END], lambda x: x IS NOT NULL) AS final FROM f),
k AS (SELECT version, set_no, format, array_to_string(final, ' ') AS final, version >= 600 AND version < 700 AND (format = 'RAR4' OR NOT list_contains(final, '-ma5')) AND list_contains(final, '-tsc-') AS skipped FROM c)"""


@R.add(f"WITH {CANDIDATES} SELECT * FROM k")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("version", "set_no", "format", F.array_join("final", " ").alias("final"), "skipped")


@R.add(f"WITH {CANDIDATES} SELECT count(*) FILTER (NOT skipped) * 4 AS runs FROM k")
def progress_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.progress_size(_candidates(spark, sf_dir))


@R.add("SELECT p_partkey, 200 + p_partkey % 600 AS version FROM part WHERE 200 + p_partkey % 600 BETWEEN 250 AND 299 OR 200 + p_partkey % 600 BETWEEN 550 AND 699")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "part").select("p_partkey", (200 + F.col("p_partkey") % 600).alias("version"))
    return cand.in_range(versions, spark.createDataFrame([(250, 300), (550, 700), (720, 720)], "start long, end long"))


@R.add("""SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_found, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS first_combination, count(*) FILTER (o_orderstatus = 'F') AS n_found FROM orders GROUP BY 1""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("found"), F.col("o_orderpriority").alias("combination"))
    return match.first_match(runs, ["o_custkey"])


@R.add("""SELECT p_partkey, p_brand, 'hit' AS phase FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 1900) OR NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice > 1900) UNION ALL SELECT s_suppkey, s_name, 'all' FROM supplier""")
def phase1_semijoin_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand is wanted; and suppliers, of which none is wanted, so that all stay."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    wanted = part.where("p_retailprice > 1900").select("p_brand")
    hit = match.semijoin_or_all(part.select("p_partkey", "p_brand"), wanted, ["p_brand"]).withColumn("phase", F.lit("hit"))
    none = match.semijoin_or_all(supplier.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_brand")), supplier.select(F.concat("s_name", F.lit("?")).alias("p_brand")), ["p_brand"]).withColumn("phase", F.lit("all"))
    return hit.unionByName(none)


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return match.running(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "size"], "size")


EXTENTS = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS size, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM lineitem)"


@R.add(f"WITH {EXTENTS} SELECT o_orderkey, pos, l_linenumber, l_partkey FROM (SELECT o_orderkey, o_custkey % 120 AS pos FROM orders) JOIN x ON o_orderkey = l_orderkey AND pos >= upto - size AND pos < upto")
def extent_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order that holds a logical position."""
    positions = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("pos"))
    spans = _extents(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("before").alias("start"), F.col("upto").alias("stop"))
    return extents.lookup(positions, spans, ["o_orderkey"], 64).select("o_orderkey", "pos", "l_linenumber", "l_partkey")


@R.add(f"WITH {EXTENTS} SELECT l_orderkey, l_linenumber, l_partkey, size, upto - size AS before, least(size, o_custkey % 100 - (upto - size)) AS take FROM x JOIN orders ON l_orderkey = o_orderkey WHERE least(size, o_custkey % 100 - (upto - size)) > 0")
def running_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    limits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).alias("limit"))
    out = extents.clipped(li, limits, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "size"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "size", "before", "take")


@R.add("""SELECT o_orderkey, x.field, x.before, x.after FROM orders, LATERAL (VALUES ('host', CAST(o_custkey % 6 AS VARCHAR), '3', o_custkey % 6 <> 3), ('priority', o_orderpriority, upper(o_orderpriority), o_orderpriority <> upper(o_orderpriority)),
('status', o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'F' END, o_custkey % 2 = 0 AND o_orderstatus <> 'F')) AS x(field, before, after, d) WHERE x.d""")
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 6).alias("host"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    targets = {"host": F.lit(3).cast("long"), "priority": F.upper("priority"), "status": F.when(F.col("o_custkey") % 2 == 0, "F")}
    return edit.patch_plan(orders, targets, ["o_orderkey"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as its stored files, in order."""
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit(".nfo")).alias("name"), "doc_id")
    return diff.positioned(docs, ["source"], ["doc_id"], "ord").select("source", F.col("ord").cast("long").alias("ord"), "name")


STORED = "s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord, 'Doc' || doc_id || '.nfo' AS name FROM documents)"


@R.add(f"WITH {STORED} SELECT * FROM s UNION ALL SELECT source, n, 'added.sfv' FROM (SELECT source, count(*) AS n FROM s GROUP BY 1)")
def stored_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    more = stored.select("source").distinct().select("source", F.lit(0).cast("long").alias("ord"), F.lit("added.sfv").alias("name"))
    return edit.add(stored, more, ["source"])


@R.add(f"WITH {STORED} SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS ord, name FROM s WHERE name NOT LIKE '%7.nfo'")
def stored_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    return edit.remove(stored, stored.where(F.endswith("name", F.lit("7.nfo"))).select("source", F.upper("name").alias("name")), ["source"])


@R.add(f"WITH {STORED} SELECT source, ord, CASE WHEN ord = 1 THEN 'renamed.nfo' ELSE name END AS name FROM s")
def stored_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    return edit.rename(stored, stored.where("ord = 1").select("source", F.upper("name").alias("old"), F.lit("renamed.nfo").alias("new")), ["source"])


@R.add(f"""WITH {STORED}, n AS (SELECT source, count(*) AS n FROM s GROUP BY 1) SELECT source, CASE WHEN n < 4 THEN ord WHEN ord = 0 THEN 3 WHEN ord <= 3 THEN ord - 1 ELSE ord END AS ord, name FROM s JOIN n USING (source)""")
def stored_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    return edit.move(stored, stored.where("ord = 0").select("source", "name", F.lit(3).cast("long").alias("by")), ["source"])


@R.add("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, count(*) AS n_lines, max(l_partkey) AS max_part FROM lineitem GROUP BY 1, 2")
def block_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by block type: volume sizes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.count("*").alias("n_lines"), F.max("l_partkey").alias("max_part"))

